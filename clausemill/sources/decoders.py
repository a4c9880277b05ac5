"""What turns the bytes of a file into pages; decoders of other formats are the caller's."""

from __future__ import annotations


def text_pages(content: bytes) -> list[str]:
    """The default: UTF-8 text with form feeds between pages."""
    return [x.strip() for x in content.decode("utf-8", "replace").split("\f")]
