from clipweave.functions.geometry import (
    clamp,
    even_down,
    floor_div,
    trunc_int,
    vertical_height,
    vertical_width,
)
from clipweave.functions.rows import compute_once
from clipweave.functions.text import (
    output_name,
    safe_title,
    seconds_text,
    session_key,
    slug,
    strip,
    title_from_path,
    wrap_text,
)

__all__ = [
    "clamp",
    "compute_once",
    "even_down",
    "floor_div",
    "output_name",
    "safe_title",
    "seconds_text",
    "session_key",
    "slug",
    "strip",
    "title_from_path",
    "trunc_int",
    "vertical_height",
    "vertical_width",
    "wrap_text",
]
