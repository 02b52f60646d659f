"""Reports of progress: anything with these methods can follow a build or an analysis."""

from __future__ import annotations

import sys
import time
from typing import Protocol, TextIO


class Progress(Protocol):
    def start(self, what: str, total: int | None = None) -> None: ...

    def step(self, message: str) -> None: ...

    def child(self, what: str) -> Progress: ...

    def finish(self) -> None: ...


class Silent:
    """Reports nothing."""

    def start(self, what: str, total: int | None = None) -> None:
        pass

    def step(self, message: str) -> None:
        pass

    def child(self, what: str) -> Silent:
        return self

    def finish(self) -> None:
        pass


class Text:
    """A line for each report, indented by depth."""

    def __init__(self, out: TextIO = sys.stderr, depth: int = 0) -> None:
        self.out, self.depth, self.done, self.total, self.what = out, depth, 0, None, ""

    def _say(self, message: str) -> None:
        print("  " * self.depth + message, file=self.out, flush=True)

    def start(self, what: str, total: int | None = None) -> None:
        self.what, self.done, self.total = what, 0, total
        self._say(what)

    def step(self, message: str) -> None:
        self.done += 1
        self._say(f"[{self.done}/{self.total}] {message}" if self.total else f"[{self.done}] {message}")

    def child(self, what: str) -> Text:
        inner = type(self)(self.out, self.depth + 1)
        inner.start(what)
        return inner

    def finish(self) -> None:
        self._say(f"{self.what}: done")


class Bar(Text):
    """One line that fills up, with the time since the start, the rate and the time that is left."""

    WIDTH = 40

    def start(self, what: str, total: int | None = None) -> None:
        self.began = time.monotonic()
        super().start(what, total)

    def step(self, message: str) -> None:
        self.done += 1
        print("\r" + self.line(time.monotonic() - self.began, message), end="", file=self.out, flush=True)

    def line(self, elapsed: float, message: str) -> str:
        """The line as it stands after so many seconds."""
        clock = lambda s: f"{int(s) // 3600:02}:{int(s) // 60 % 60:02}:{int(s) % 60:02}"
        total = max(self.total or self.done, self.done)
        filled = self.WIDTH * self.done // max(total, 1)
        rate = self.done / elapsed if elapsed > 0 else 0.0
        left = clock((total - self.done) / rate) if rate else "-"
        return f"{self.what} [{clock(elapsed)}] [{'#' * filled:-<{self.WIDTH}}] {self.done}/{total} ({rate:.1f}/s, {left}) {message}"

    def finish(self) -> None:
        print(file=self.out, flush=True)
