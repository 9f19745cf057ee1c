from clipweave.plans.batch import batch_outcomes
from clipweave.plans.clips import (
    clip_crop_ranges,
    clip_manifest,
    many_clip_manifest,
    many_clips,
    manifest,
    single_clips,
)
from clipweave.plans.unattended import run_until

__all__ = [
    "batch_outcomes",
    "clip_crop_ranges",
    "clip_manifest",
    "many_clip_manifest",
    "many_clips",
    "manifest",
    "run_until",
    "single_clips",
]
