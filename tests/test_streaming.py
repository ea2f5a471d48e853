import os
import tempfile

from twinvec.streaming import start_word_counts


def test_stream_counts_resume_from_checkpoint(spark):
    d = tempfile.mkdtemp(prefix="twinvec-stream-", dir="/tmp")
    loc = tempfile.mkdtemp(prefix="twinvec-stream-ckpt-", dir="/tmp")
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("the cat sat on the mat")
    q = start_word_counts(spark, d, "wc_first", sink="memory", checkpoint_location=loc)
    q.awaitTermination(120)
    got = {r["word"]: r["freq"] for r in spark.sql("SELECT * FROM wc_first").collect()}
    assert got == {"the": 2, "cat": 1, "sat": 1, "on": 1, "mat": 1}
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write("the\tdog")
    # A restarted query resumes from the saved state and reads only the new file.
    q2 = start_word_counts(spark, d, "wc_second", sink="memory", checkpoint_location=loc)
    q2.awaitTermination(120)
    got2 = {r["word"]: r["freq"] for r in spark.sql("SELECT * FROM wc_second").collect()}
    assert got2["the"] == 3 and got2["dog"] == 1 and got2["cat"] == 1
