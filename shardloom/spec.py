"""Shape of the tensors in a dataset; always declared, never guessed from the data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DatasetSpec:
    channels: int
    height: int
    width: int

    @property
    def plane(self) -> int:
        """Values per channel."""
        return self.height * self.width

    @property
    def size(self) -> int:
        """Values per sample."""
        return self.channels * self.plane

    @property
    def shape(self) -> list[int]:
        return [self.channels, self.height, self.width]
