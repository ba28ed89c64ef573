"""Logging set-up: level by name, text or JSON lines."""

from __future__ import annotations

import json
import logging
import sys

NAME = "lodestack"
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR}


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "msg": record.getMessage()}
        return json.dumps(out | getattr(record, "fields", {}), default=str)


def init(level: str = "info", style: str = "text", stream=None) -> logging.Logger:
    """Configure the package's logger; unknown levels mean info."""
    log = logging.getLogger(NAME)
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(_Json() if style == "json" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(LEVELS.get(level.lower(), logging.INFO))
    log.propagate = False
    return log


def with_fields(**fields) -> logging.LoggerAdapter:
    """The logger with fields on every JSON line."""
    return logging.LoggerAdapter(logging.getLogger(NAME), {"fields": fields})
