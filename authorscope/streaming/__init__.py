"""Scoring a stream of files.

File scoring is a map, so a streaming table needs no state and no watermark: the batch operator runs as it is. Category and
repository sums are kept beside it by merging the sums of each batch.
"""

from .files import write_file_scores
from .totals import add_batch, read_repository_scores, write_repository_scores

__all__ = ["add_batch", "read_repository_scores", "write_file_scores", "write_repository_scores"]
