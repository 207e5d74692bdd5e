"""Limits of input sizes, and guards of paths that come from configuration."""

from __future__ import annotations

from pathlib import Path

from loomtext.errors import InvalidConfig, InvalidData, TooLarge

MAX_MODEL_BYTES = 512 << 20
MAX_THREADS = 256
MAX_YAML_BYTES = 512 << 10
MAX_FILE_BYTES = 8 << 20
MAX_FILES = 10_000
MAX_RULES = 10_000
MAX_RULE_BYTES = 2048


def output_path(path: str, base: str | None = None) -> Path:
    """A relative path that names a file and stays below base (the present folder unless given)."""
    p = Path(path)
    if not path or p.is_absolute() or ".." in p.parts:
        raise InvalidConfig("output path", f"{path!r} must be relative and without ..")
    if not p.name:
        raise InvalidConfig("output path", f"{path!r} names no file")
    if base is None:
        return p
    root = Path(base).resolve()
    full = root / p
    near = full
    while not near.exists():
        near = near.parent
    if not near.resolve().is_relative_to(root):
        raise InvalidConfig("output path", f"{path!r} leaves {root}")
    return full


def input_path(path: str, base: str | None = None) -> Path:
    """An existing path: absolute, or relative to the present folder or to base, in which it must stay."""
    p = Path(path)
    if p.is_absolute():
        if not p.exists():
            raise InvalidConfig("input path", f"{path!r} doesn't exist")
        return p.resolve()
    for root in (Path.cwd(), *([Path(base)] if base else [])):
        if (root / p).exists():
            full = (root / p).resolve()
            if not full.is_relative_to(root.resolve()):
                raise InvalidConfig("input path", f"{path!r} leaves {root}")
            return full
    raise InvalidConfig("input path", f"{path!r} doesn't exist")


def read_bytes(path: str | Path, limit: int) -> bytes:
    p = Path(path)
    if not p.is_file():
        raise InvalidConfig("read", f"{p} is no file")
    if p.stat().st_size > limit:
        raise TooLarge("read", f"{p} is over {limit} bytes")
    return p.read_bytes()


def read_text(path: str | Path, limit: int = MAX_FILE_BYTES) -> str:
    try:
        return read_bytes(path, limit).decode()
    except UnicodeDecodeError as e:
        raise InvalidData("read", f"{path} isn't UTF-8: {e}") from e
