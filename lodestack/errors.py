"""Typed errors and argument checks."""

from __future__ import annotations

import os

VALIDATION, NOT_FOUND, INTERNAL, EXTERNAL, CONFLICT = "VALIDATION", "NOT_FOUND", "INTERNAL", "EXTERNAL", "CONFLICT"


class AppError(Exception):
    """An error with a kind, an optional cause and context values."""

    def __init__(self, kind: str, message: str, cause: BaseException | None = None):
        super().__init__(message)
        self.kind, self.message, self.cause, self.context = kind, message, cause, {}

    def __str__(self) -> str:
        return f"{self.kind}: {self.message}" + (f" (caused by: {self.cause})" if self.cause else "")

    def with_context(self, key: str, value) -> "AppError":
        self.context[key] = value
        return self


def is_kind(error: BaseException | None, kind: str) -> bool:
    """Whether an error, or one it was raised from, is of a kind."""
    while error is not None:
        if isinstance(error, AppError) and error.kind == kind:
            return True
        error = getattr(error, "cause", None) or error.__cause__
    return False


def validation(message: str) -> AppError:
    return AppError(VALIDATION, message)


def not_found(message: str) -> AppError:
    return AppError(NOT_FOUND, message)


def conflict(message: str) -> AppError:
    return AppError(CONFLICT, message)


def check_directory(path: str) -> str:
    if not path:
        raise validation("path must not be empty")
    if ".." in path.replace("\\", "/").split("/"):
        raise validation("path must not contain '..'")
    if not os.path.exists(path):
        raise not_found(f"no such path: {path}")
    return path


def check_non_empty(value: str, name: str) -> str:
    if not value or not value.strip():
        raise validation(f"{name} must not be empty")
    return value


def check_range(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise validation(f"{name} must be between {low} and {high}, not {value}")
    return value


def check_one_of(value: str, allowed, name: str) -> str:
    if value not in allowed:
        raise validation(f"{name} must be one of {', '.join(allowed)}, not {value}")
    return value
