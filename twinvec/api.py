"""The public surface under the names a user of the reference looks for.

Every function takes and returns DataFrames; see the operator modules for the semantics.
"""

from __future__ import annotations

from twinvec.operators import analogy as _analogy
from twinvec.operators import corpus as _corpus
from twinvec.operators import embeddings as _emb
from twinvec.operators import evaluate as _evaluate
from twinvec.operators import neighbors as _nb
from twinvec.operators import sampling as _sampling
from twinvec.operators import tagging as _tagging
from twinvec.operators import training as _training
from twinvec.operators.project import project_2d
from twinvec.sources.corpus import read_similarity, read_tagged, read_text_corpus

# Corpus
corpus_from_text = read_text_corpus
corpus_from_table = _corpus.documents_tokens
build_vocab = _corpus.build_vocab
encode = _corpus.encode
encode_documents = _corpus.encode_documents
subsample = _corpus.subsample
skipgram_pairs = _corpus.epoch_pairs
pair_stream = _corpus.epoch_stream

# Sampling
noise_distribution = _sampling.noise
sample_negatives = _sampling.shared_negatives
sample_pair_negatives = _sampling.per_pair_negatives

# Training
fit = _training.train
resume = _training.resume
resume_from = _training.resume_from
continue_run = _training.continue_run
save = _training.save
restore = _training.restore

# Embeddings
load_embeddings = _emb.from_table
export = _emb.export

# Vector queries
nearby = _nb.nearby
similarities = _nb.similarities
neighbor_report = _nb.neighbor_report
neighbor_report_wide = _nb.report_wide
panels_side_by_side = _nb.panels_side_by_side
neighborhood = _nb.neighborhood
lookup_ids = _nb.lookup_ids


def context_scores(emb, query_ids, k: int = 20, **kw):
    """K5: top words by ``w_i . Q . w_j``."""
    return _nb.nearby(emb, query_ids, ("context",), k, **kw)


analogy = _analogy.answer
analogy_panels = _analogy.analogy_panels
analogy_report = _analogy.report
read_questions = _analogy.read_questions

# Evaluations
eval_analogies = _analogy.evaluate
eval_analogy_objectives = _analogy.eval_objectives
eval_similarity = _evaluate.eval_similarity
next_tag_dataset = _tagging.next_tag_dataset
next_tag_documents = _tagging.next_tag_documents
eval_next_tag = _tagging.tag_accuracy

__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"] + ["project_2d", "read_similarity",
                                                                               "read_tagged"]
