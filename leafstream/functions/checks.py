"""Checks of request parameters: a good value is returned, a bad one raises ValueError."""

from __future__ import annotations

import re

_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
FORMATS, KINDS = ("png", "jpeg", "pdf", "html", "json"), ("all", "text", "tag")


def file_key(value: str) -> str:
    """An upload's id: a UUID."""
    if not _UUID.fullmatch(value):
        raise ValueError(f"not a file id: {value!r}")
    return value.lower()


def number(value: str | int, least: int, most: int | None = None, name: str = "number") -> int:
    """A whole number within its limits, also as text."""
    text = str(value).strip()
    if not re.fullmatch(r"\d{1,18}", text) or int(text) < least or (most is not None and int(text) > most):
        raise ValueError(f"{name} is a whole number from {least}" + (f" to {most}" if most is not None else ""))
    return int(text)


def page_number(value: str | int) -> int:
    return number(value, 1, name="page")


def dpi(value: str | int = 96) -> int:
    return number(value, 36, 600, "dpi")


def most_results(value: str | int = 100) -> int:
    return number(value, 1, 1000, "most")


def one_of(value: str, allowed: tuple[str, ...], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} is one of {', '.join(allowed)}")
    return value


def search_request(file_id: str, query: str, kind: str = "all", most: str | int = 100) -> dict:
    """A search's parameters."""
    if not query.strip():
        raise ValueError("the query is empty")
    return {"file_id": file_key(file_id), "query": query.strip(), "kind": one_of(kind, KINDS, "kind"), "most": most_results(most)}


def render_request(file_id: str, page: str | int, resolution: str | int = 96, form: str = "png") -> dict:
    """A page rendering's parameters."""
    return {"file_id": file_key(file_id), "page": page_number(page), "dpi": dpi(resolution), "format": one_of(form, FORMATS, "format")}
