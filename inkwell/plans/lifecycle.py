"""What a session has opened, closed in reverse order even if some of it fails to."""

from __future__ import annotations

from collections.abc import Callable

from inkwell.plans.errors import SafeError, to_safe


class Lifecycle:
    """Registers cleanups (streams to stop, tables to unpersist, cuts to drop); close runs each once, the newest first."""

    def __init__(self):
        self._open: list[tuple[str, Callable[[], object]]] = []
        self.closed = False

    def add(self, name: str, cleanup: Callable[[], object]) -> Callable[[], None]:
        """Registers a cleanup; what is returned takes it back. A closed lifecycle cleans up at once."""
        if self.closed:
            cleanup()
            return lambda: None
        entry = (name, cleanup)
        self._open.append(entry)
        return lambda: self._open.remove(entry) if entry in self._open else None

    def close(self) -> list[tuple[str, SafeError]]:
        """The cleanups that failed, by name; a second call does nothing."""
        failed, self.closed = [], True
        while self._open:
            name, cleanup = self._open.pop()
            try:
                cleanup()
            except Exception as error:
                failed.append((name, to_safe(error, "CLEANUP_FAILURE")))
        return failed

    def __enter__(self) -> Lifecycle:
        return self

    def __exit__(self, *_) -> None:
        self.close()
