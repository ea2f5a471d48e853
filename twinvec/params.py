"""Frozen parameter object replacing the reference's process flags."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Word2VecParams:
    # Defaults of the original trainer.
    embedding_size: int = 200
    epochs_to_train: int = 15
    learning_rate: float = 0.2
    num_neg_samples: int = 100
    batch_size: int = 16
    window_size: int = 5
    min_count: int = 5
    subsample: float = 1e-3
    sentence_size: int = 1000
    distortion: float = 0.75
    lr_decay: float = 1.2
    lr_floor: float = 1e-4
    # Values for resuming: 10 more epochs starting at rate 0.052.
    resume_epochs: int = 10
    resume_learning_rate: float = 0.052
    # Our own knobs (no counterpart in the reference).
    seed: int = 42
    shards: int = 16
    pairs_per_round: int = 65_536

    def with_(self, **kw) -> "Word2VecParams":
        return replace(self, **kw)
