"""A cache of bounded size that keeps what was used lately."""

from __future__ import annotations

from typing import Any


class Recent(dict):
    """key -> ``make(key)``, computed where it is not held.

    At most twice ``most`` keys are held: once ``most`` are there they become the older half, from
    which a key that is asked for comes back. Strings longer than ``longest`` are not kept.
    """

    def __init__(self, most: int, longest: int):
        super().__init__()
        self.most, self.longest, self.older = most, longest, {}

    def make(self, key: Any) -> Any:
        raise NotImplementedError

    def __missing__(self, key: Any) -> Any:
        if (value := self.older.get(key)) is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
