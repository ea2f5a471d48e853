"""Streaming forms of the corpus job.

The reference has no event time, watermark or windowed aggregation; its only stream is the
corpus cursor. Here new corpus files arriving in a folder update the word counts (A1) as a
stateful Structured Streaming aggregation; the state lives in the checkpoint folder, so a
restarted query resumes where it stopped.
"""

from twinvec.streaming.word_counts import start_word_counts, word_count_stream

__all__ = ["start_word_counts", "word_count_stream"]
