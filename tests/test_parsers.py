"""Parsers, the Go scanner and the chunker on literal sources."""

import pytest

from lodestack.sources import chunker, golang, parsers


def parse(spark, path, source):
    df = spark.createDataFrame([(path, bytearray(source.encode()))], "path string, content binary")
    return parsers.parse(df).orderBy("seq").collect()


def names(rows):
    return [r.metadata.get("name") for r in rows]


GO = '''// Package doc
package main

import (
	"fmt"
	str "strings"
	_ "os"
)

import "math"

type (
	User struct{ Name string }
	Status int
)

const answer = 42

var table = map[string]func(int) int{
	"a": func(x int) int { return twice(x) },
}

/* block
comment */
func main() {
	helper("} not a brace", '}', `raw {
	text`)
	fmt.Println(process(1), a.b.Deep(), []int{1}[0])
	go func(n int) { inner(n) }(3)
	if x := check(); x { return }
}

func (s *Server) Handle(w http.ResponseWriter, r *http.Request) error {
	return s.save(r)
}

func (User) Plain() {}
func (l List[T]) Generic() {}
func helper(a string, b rune, c string) {}
func external(x int) int
'''


def test_go_declarations():
    d = golang.declarations(GO)
    kinds = [(x["chunk_type"], x["metadata"].get("name")) for x in d]
    assert kinds == [("import", None), ("import", None), ("class", "User"), ("other", None), ("other", None), ("function", "main"), ("method", "Handle"), ("method", "Plain"), ("method", "Generic"), ("function", "helper"), ("function", "external")]
    by = {x["metadata"].get("name"): x for x in d}
    assert d[0]["metadata"]["imports"] == "fmt,strings,os" and d[1]["metadata"]["imports"] == "math"
    assert by["User"]["metadata"]["types"] == "User,Status"
    assert by["main"]["metadata"]["calls"] == "check,fmt.Println,helper,inner,process"
    assert by["Handle"]["metadata"] == {"receiver": "Server", "name": "Handle", "calls": "s.save"}
    assert by["Plain"]["metadata"]["receiver"] == "User" and "receiver" not in by["Generic"]["metadata"]
    assert by["main"]["content"].startswith("func main() {") and by["main"]["content"].endswith("}")
    assert (by["main"]["start_line"], by["main"]["end_line"]) == (25, 31)


@pytest.mark.parametrize("bad", ["", "func main() {}", "package a\nfunc {", "package a\nfunc f() { ) }", 'package a\nvar s = "open', "package a\nx := 1", "package a\nfunc f() {\n"])
def test_go_syntax_errors(bad):
    with pytest.raises(golang.GoSyntaxError):
        golang.declarations(bad)


def test_go_through_spark(spark):
    rows = parse(spark, "a.go", GO)
    assert len(rows) == 11 and rows[5].metadata["name"] == "main" and rows[5].language == "go"
    df = spark.createDataFrame([("b.go", bytearray(b"package x\nfunc (")), ("c.go", bytearray(b"package x"))], "path string, content binary")
    assert parsers.parse(df).count() == 0 and [r.path for r in parsers.parse_errors(df).collect()] == ["b.go"]


@pytest.mark.parametrize("path,source,want", [
    ("a.py", "import os\n\ndef hello():\n    pass\n\nasync def fetch(x):\n    pass\n\nclass MyClass:\n    pass\n", ["hello", "fetch", "MyClass"]),
    ("a.js", "function greet(n) {\n}\nclass Animal {\n}\nconst add = (a) => a;\nexport async function fetchData(u) {}\n", ["greet", "Animal", "const", "fetchData"]),
    ("a.ts", "export interface User {\n}\nclass UserService {\n}\nasync function fetchUser(id: number) {}\n", ["User", "UserService", "fetchUser"]),
    ("a.rs", "pub struct Point {\n  x: i32,\n}\nimpl Point {\n  pub fn new() -> Self { }\n}\nfn distance() -> f64 { }\n", ["Point", "Point", "new", "distance"]),
    ("a.rb", "module Greeter\n  class Hello\n    def greet(n)\n    end\n  end\nend\n", ["Greeter", "Hello", "greet"]),
    ("a.sh", "#!/bin/bash\nfunction setup {\n}\ncleanup() {\n}\n", ["setup", "cleanup"]),
])
def test_pattern_blocks(spark, path, source, want):
    assert names(parse(spark, path, source)) == want


def test_block_ends_and_types(spark):
    rows = parse(spark, "a.py", "skip me\ndef a():\n    x  \n \n\t\nclass B:\n    pass")
    assert [(r.content, r.start_line, r.end_line, r.chunk_type) for r in rows] == [("def a():\n    x  ", 2, 3, "function"), ("class B:\n    pass", 6, 7, "class")]


def test_line_windows(spark):
    spans = lambda rows: [(r.start_line, r.end_line) for r in rows]
    assert spans(parse(spark, "a.py", "\n".join(["x = 1"] * 60))) == [(1, 50), (46, 60)]
    assert spans(parse(spark, "a.md", "# Section\nSome text here.\n\n" * 30)) == [(1, 50), (46, 91)]
    assert spans(parse(spark, "a.json", '{"a": 1}')) == [(1, 1)]
    assert parse(spark, "a.md", "") == [] and parse(spark, "a.xyz", "text") == [] and parse(spark, "a.md", " \n\u00a0\n") == []
    assert spans(parse(spark, "a.sql", "x\n" * 49 + "x")) == [(1, 50)]
    assert spans(parse(spark, "a.sql", "x\n" * 50 + "x")) == [(1, 50), (46, 51)]


def test_split_spans():
    lines = "\n".join(f"line of code {chr(65 + i)}" for i in range(20)) + "\n"
    assert [len(lines)] + chunker.split_spans(lines.encode(), 100, 20) == [300, (0, 90), (80, 180), (160, 255), (240, 300)]
    assert chunker.split_spans(b"a()" + b"x" * 297, 100, 20) == [(0, 3), (80, 180), (160, 260), (240, 300)]
    whole = chunker.split_spans(b"a()" + b"x" * 297, 100, 20, lossless=True)
    assert all(b >= c for (_, b), (c, _) in zip(whole, whole[1:])) and whole[-1][1] == 300
    assert chunker.split_spans(b"x" * 10, 4, 9) == [(0, 4), (2, 6), (4, 8), (6, 10)]
    assert chunker.break_point(b"ab\n\ncd" + b"e" * 20, 0, 10, 10) == 4


def test_pieces_are_led_by_context():
    pieces = chunker.split_pieces("f.py", "é" * 300, 5, 100, 21)
    assert pieces[0][2] == 5 and all(p[1].startswith("// ...context...\n") for p in pieces[1:])
    assert pieces[1][2:] == (5, 6) and "\ufffd\ufffd" not in "".join(p[1] for p in pieces)
    assert [len(p[1].encode()) for p in chunker.split_pieces("f", "\n".join(f"line of code {chr(65 + i)}" for i in range(20)) + "\n", 1, 100, 20)] == [90, 137, 132, 97]


def test_chunk_and_merge(spark):
    rows = [("f.go", "go", "// doc", "comment", 1, 1, {"a": "1", "b": "c"}, 0), ("f.go", "go", "func f() {}", "function", 2, 2, {"b": "x", "name": "f"}, 1), ("f.go", "go", "y" * 700, "other", 3, 3, None, 2), ("f.go", "go", "// end", "comment", 4, 4, {}, 3)]
    df = spark.createDataFrame(rows, "file_path string, language string, content string, chunk_type string, start_line int, end_line int, metadata map<string,string>, seq int")
    got = chunker.chunk(df).orderBy("start_line", "id").collect()
    first = next(r for r in got if r.start_line == 1)
    assert first.content == "// doc\nfunc f() {}" and first.chunk_type == "function" and first.end_line == 2
    assert first.metadata == {"a": "1", "b": "x", "name": "f", "symbol_name": "f", "merged_from_comment": "true", "chunk_type": "function", "language": "go", "file_path": "f.go"}
    big = [r for r in got if r.chunk_type == "other"]
    assert len(big) == 2 and {r.metadata["start_line"] for r in big} == {"3"} and len({r.id for r in got}) == len(got)
    assert chunker.chunk(df, merge=False).filter("chunk_type = 'comment'").count() == 2
    assert sorted(r.id for r in chunker.chunk(df).collect()) == sorted(r.id for r in got)
