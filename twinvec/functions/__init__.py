from twinvec.functions.rand import uniform, uniform_sql
from twinvec.functions.text import parse_word_list, split_tokens
from twinvec.functions.vectors import (dot, l2_normalize, safe_norm, sign_flip, sq_norm, x_part,
                                       y_part)

__all__ = ["uniform", "uniform_sql", "split_tokens", "parse_word_list", "dot", "l2_normalize",
           "safe_norm", "sign_flip", "sq_norm", "x_part", "y_part"]
