"""Folders for results that several jobs read: in the checkpoint folder that all machines share."""

from __future__ import annotations

import uuid

from lorekiln.operators.components import cut, ensure_checkpoint_dir

__all__ = ["cut", "ensure_checkpoint_dir", "shared_folder"]


def shared_folder(spark, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
