from clipweave.streaming.approvals import approve_stream
from clipweave.streaming.attempts import settle_stream
from clipweave.streaming.smoothing import smooth_stream
from clipweave.streaming.worklist import items_stream, start_items, start_runs

__all__ = ["approve_stream", "items_stream", "settle_stream", "smooth_stream", "start_items", "start_runs"]
