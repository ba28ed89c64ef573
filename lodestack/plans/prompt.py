"""Prompts: fit results to a budget, render a template, lead with a header; one row in one plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import validation
from ..functions import text
from ..operators import select

# The two prompt templates.
DEFAULT_TEMPLATE = """You are a helpful code assistant. Use the provided code context to answer the user's question.
If the context is insufficient, explain what's missing.

Code Context:
{{range .Results}}
--- {{.Chunk.FilePath}} (Lines {{.Chunk.StartLine}}-{{.Chunk.EndLine}}) ---
{{.Chunk.Content}}
{{end}}

Question: {{.Query}}
Answer:"""
PROFESSIONAL_TEMPLATE = """You are a senior software engineer and professional code reviewer. Your role is to:
1. **Understand the codebase** — Explain architecture, data flow, design patterns, and how components interact.
2. **Review code** — Assess correctness, maintainability, security, performance, and adherence to best practices.

Guidelines:
- Base your answers strictly on the provided code context. Cite file paths and line numbers when referencing code.
- If the context is insufficient, state what's missing and suggest where to look.
- For code review: be constructive, specific, and actionable. Prioritize critical issues (security, correctness) over style.
- For understanding: explain the "why" and relationships, not just the "what".
- Use clear structure (bullets, sections) for complex answers.

Code Context (retrieved from the codebase):
{{range .Results}}
--- {{.Chunk.FilePath}} (Lines {{.Chunk.StartLine}}-{{.Chunk.EndLine}}) ---
{{.Chunk.Content}}
{{end}}

User question: {{.Query}}

Provide a professional, well-structured response:"""

FIELDS = {".Chunk.FilePath": "file_path", ".Chunk.StartLine": "start_line", ".Chunk.EndLine": "end_line", ".Chunk.Content": "content", ".Chunk.ID": "id", ".Chunk.Language": "language", ".RelevanceScore": "relevance_score"}
ACTION = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.S)


def template_by_name(name: str) -> str:
    """``default`` gives the short template, anything else the reviewer's."""
    return DEFAULT_TEMPLATE if (name or "").strip().lower() == "default" else PROFESSIONAL_TEMPLATE


def _parts(template: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in ACTION.finditer(template):
        out += [("text", template[at : m.start()]), ("action", m[1])]
        at = m.end()
    rest = template[at:]
    if "{{" in rest:
        raise validation("template has an unclosed action")
    return out + [("text", rest)]


class Template:
    """A template with ``{{.Query}}`` and at most one ``{{range .Results}} … {{end}}``; checked when made."""

    def __init__(self, source: str = ""):
        self.before, self.item, self.after = [], [], []
        here = self.before
        for kind, value in _parts(source or DEFAULT_TEMPLATE):
            if kind == "text":
                here.append(("text", value))
            elif value == "range .Results":
                if here is not self.before:
                    raise validation("template has a second range")
                here = self.item
            elif value == "end":
                if here is not self.item:
                    raise validation("template has an end without a range")
                here = self.after
            elif value == ".Query" or value in FIELDS and here is self.item:
                here.append(("field", value))
            else:
                raise validation(f"template has an unknown action {value!r}")
        if here is self.item:
            raise validation("template has a range without an end")

    @staticmethod
    def _column(parts, query: Column) -> Column:
        cols = [F.lit(v) if k == "text" else query if v == ".Query" else F.col(FIELDS[v]).cast("string") for k, v in parts]
        return F.concat(*cols) if cols else F.lit("")

    def render(self, fitted: DataFrame, query: Column, total: DataFrame, header: dict[str, Column]) -> DataFrame:
        """One row (prompt, context_results, source_files)."""
        items = F.collect_list(F.struct("prompt_rank", self._column(self.item, query).alias("t")))
        body = F.array_join(F.transform(F.sort_array(items), lambda x: x["t"]), "")
        files = F.array_join(F.array_sort(F.collect_set("file_path")), ", ")
        agg = fitted.agg(body.alias("body"), files.alias("source_files"), F.count(F.lit(1)).alias("context_results")).crossJoin(total)
        keys = ["generated_at", "model", "context_results", "total_results", "max_tokens", "source_files"]
        own = {"context_results": F.col("context_results").cast("string"), "total_results": F.col("total_results").cast("string"), "source_files": F.col("source_files")} | header
        line = F.concat_ws(" | ", *[F.concat(F.lit(f"{k}="), own[k]) for k in keys if k in own])
        whole = F.concat(F.lit("<!-- RAG context: "), line, F.lit(" -->\n"), self._column(self.before, query), F.col("body"), self._column(self.after, query))
        return agg.select(whole.alias("prompt"), "context_results", "source_files")


def generate(results: DataFrame, query: str, template: str = "", max_tokens: int = 0, chars_per_token: int = 4, model: str = "", generated_at: Column | None = None) -> DataFrame:
    """Prompt of a query from results (file_path, start_line, end_line, content, relevance_score, id)."""
    compiled = Template(template)
    fitted = select.prompt_fit(results, max_tokens, chars_per_token if chars_per_token > 0 else 4)
    header = {"generated_at": text.rfc3339(F.current_timestamp() if generated_at is None else generated_at)}
    if model:
        header["model"] = F.lit(model)
    if max_tokens > 0:
        header["max_tokens"] = F.lit(str(max_tokens))
    return compiled.render(fitted, F.lit(query), results.agg(F.count(F.lit(1)).alias("total_results")), header)
