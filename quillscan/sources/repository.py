"""Repositories: which addresses may be cloned, cloning with a fallback, and diffs between references."""

from __future__ import annotations

import contextlib
import os
import re
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

#: Schemes that may be cloned, unless QUILLSCAN_GIT_SCHEMES names others.
SCHEMES = ["https", "ssh", "git+ssh"]


class SourceError(ValueError):
    pass


def scheme(url: str) -> str:
    """The scheme of an address: a remote helper's name, the scheme before ://, ssh for host:path, file otherwise."""
    if m := re.match(r"([A-Za-z][\w+.-]*)::", url):
        return m[1].lower()
    if m := re.match(r"([A-Za-z][\w+.-]*)://", url):
        return m[1].lower()
    return "ssh" if re.match(r"(?:[\w.-]+@)?[\w.-]+:(?![\\/]{2})[^\\]", url) and not re.match(r"[A-Za-z]:[\\/]", url) else "file"


def allowed(url: str) -> bool:
    named = os.environ.get("QUILLSCAN_GIT_SCHEMES")
    return scheme(url) in ([s.strip().lower() for s in named.split(",") if s.strip()] if named else SCHEMES)


def safe_ref(ref: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9][\w./^~-]*", ref)) and ".." not in ref


@contextlib.contextmanager
def checkout(path: str | None = None, url: str | None = None, within: str | None = None) -> Iterator[tuple[str, list[str]]]:
    """A folder with the sources, and warnings. A clone that fails falls back to path; a scheme that isn't allowed never does.

    Runs on the driver. A clone goes below `within`, which on a cluster must be a folder that executors share
    (shared.mounted tells it), and is removed at the end.
    """
    if url is None:
        if not path or not Path(path).is_dir():
            raise SourceError(f"{path}: no folder")
        yield path, []
        return
    if not allowed(url):
        raise SourceError(f"scheme {scheme(url)!r} is not allowed")
    with tempfile.TemporaryDirectory(prefix="quillscan-", dir=within) as tmp:
        done = subprocess.run(["git", "clone", "--depth", "1", "--", url, tmp], capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})
        if done.returncode == 0:
            yield tmp, []
        elif path and Path(path).is_dir():
            yield path, [f"clone failed, using {path}"]
        else:
            raise SourceError(f"clone failed: {done.stderr.strip()[-200:]}")


def diff(repo: str, base: str, head: str) -> str:
    """The diff between two references with no context lines, of files added, copied, modified or renamed."""
    for ref in (base, head):
        if not safe_ref(ref):
            raise SourceError(f"{ref!r}: not a reference")
    done = subprocess.run(["git", "-C", repo, "diff", "--diff-filter=ACMR", "-U0", f"{base}...{head}", "--"], capture_output=True, text=True)
    if done.returncode:
        raise SourceError(done.stderr.strip()[-200:])
    return done.stdout
