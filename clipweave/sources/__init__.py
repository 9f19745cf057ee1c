from clipweave.sources.audio import chunk_audio, chunk_audio_parts
from clipweave.sources.manifest import export_channel, read_plan, update_plan, write_channel, write_plan
from clipweave.sources.segments import explode_segments, read_segments
from clipweave.sources.state import init_state, read_state, write_outcomes
from clipweave.sources.worklist import items_from_lines, list_files, preview_items, read_items, read_lines

__all__ = [name for name in dir() if not name.startswith("_")]
