"""Token-sequence array operators (SEQ-01 .. SEQ-07, SEQ-09).

Input is token-id arrays (producing ids with a tokenizer is out of scope).
Everything is a column expression over arrays (``slice``, ``concat``,
``array_repeat``, higher-order functions), except the running sum of
:func:`position_ids`, which Spark has no scan function for: it is an Arrow
UDF doing one vectorised cumulative sum over the flattened batch, so its cost
is linear in the number of tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORE_INDEX = -100  # FIXED VALUE: label id ignored by the loss


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _ones(n: Column) -> Column:
    return F.array_repeat(F.lit(1), n)


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)))


def concat_fit(prompt, response, max_len: int, truncation: str = "right", pad_id: int = 0) -> Column:
    """SEQ-01: struct(input_ids, attention_mask) of prompt ++ response fitted
    to ``max_len``.  right/left truncation cut overlong rows; any other
    truncation name leaves them untouched; short rows are right-padded with
    ``pad_id`` and attention 0."""
    ids = F.concat(_c(prompt), _c(response))
    n = F.size(ids)
    L = F.lit(max_len)
    if truncation == "right":
        cut = F.slice(ids, 1, L)
    elif truncation == "left":
        cut = F.slice(ids, n - L + 1, L)
    else:
        cut = ids
    fitted = (F.when(n > L, cut).when(n < L, F.concat(ids, F.array_repeat(F.lit(pad_id), L - n)))
              .otherwise(ids))
    attn = F.when(n >= L, _ones(F.size(fitted))).otherwise(F.concat(_ones(n), _zeros(L - n)))
    return F.struct(fitted.alias("input_ids"), attn.alias("attention_mask"))


def loss_mask(attention, prompt_len, total_len, max_len: int, shift: bool = False) -> Column:
    """SEQ-02: copy of the attention mask with [0, P-1) zeroed when
    P = min(prompt_len, L) > 1 and position min(total, L) - 1 zeroed.

    With ``shift=True`` the mask is moved left by one (the loss's own shift),
    so the last prompt token is trained and the end token is not.
    """
    a = _c(attention)
    P = F.least(_c(prompt_len), F.lit(max_len))
    T = F.least(_c(total_len), F.lit(max_len))
    m = F.transform(a, lambda x, i: F.when((P > 1) & (i < P - 1), F.lit(0))
                    .when((T > 0) & (i == T - 1), F.lit(0)).otherwise(x))
    if shift:
        m = F.concat(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), F.array(F.lit(0)))
    return m


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _position_ids_arrow(mask: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(mask), 0).to_numpy().astype(np.int64)
    values = pc.list_flatten(mask).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    cs = np.cumsum(values)
    base = np.where(offsets[:-1] > 0, cs[np.maximum(offsets[:-1] - 1, 0)], 0) if len(cs) else np.zeros(len(lengths), np.int64)
    base = np.repeat(base, lengths)
    pos = np.maximum(cs - base - 1, 0).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pos, pa.int32()),
                                    mask=pc.is_null(mask))


def position_ids(mask) -> Column:
    """SEQ-03: max(0, cumsum(mask) - 1)."""
    return _position_ids_arrow(_c(mask).cast("array<int>"))


def pad_or_truncate(ids, max_len: int, pad_id: int = 0, left_pad: bool = True, truncation: str = "error",
                    is_mask: bool = False) -> Column:
    """SEQ-04: pad to ``max_len`` (left or right; a mask pads with 0) or
    truncate left / right / middle (L//2 from the head, the rest from the
    tail); ``error`` raises on an overlong row."""
    a = _c(ids)
    n = F.size(a)
    L = F.lit(max_len)
    pad = F.array_repeat(F.lit(0 if is_mask else pad_id), L - n)
    padded = F.concat(pad, a) if left_pad else F.concat(a, pad)
    if truncation == "left":
        cut = F.slice(a, n - L + 1, L)
    elif truncation == "right":
        cut = F.slice(a, 1, L)
    elif truncation == "middle":
        head = max_len // 2
        tail = max_len - head
        cut = F.concat(F.slice(a, 1, F.lit(head)), F.slice(a, n - tail + 1, F.lit(tail))) if tail > 0 \
            else F.slice(a, 1, F.lit(head))
    elif truncation == "error":
        cut = F.raise_error(F.concat(F.lit("Prompt length "), n.cast("string"),
                                     F.lit(f" is longer than max_length {max_len}."))).cast("array<int>")
    else:
        raise ValueError(truncation)
    return F.when(n < L, padded).when(n > L, cut).otherwise(a)


def teacher_forced(prompt, answer, T: int, eos_id: int, pad_id: int = 0) -> Column:
    """SEQ-05: struct(input_ids, attention_mask, labels).

    prompt (cut to T) + answer with an end id appended when absent, cut to
    the remaining room; labels are the answer ids and IGNORE_INDEX on
    prompt and padding."""
    p = F.slice(_c(prompt), 1, F.lit(T))
    a = _c(answer)
    a = F.when((F.size(a) == 0) | (F.element_at(a, -1) != F.lit(eos_id)),
               F.concat(a, F.array(F.lit(eos_id)))).otherwise(a)
    rem = F.lit(T) - F.size(p)
    a = F.when(rem > 0, F.slice(a, 1, F.greatest(rem, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    used = F.size(p) + F.size(a)
    ids = F.concat(p, a, F.array_repeat(F.lit(pad_id), F.lit(T) - used))
    attn = F.concat(_ones(used), _zeros(F.lit(T) - used))
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(p)), a,
                      F.array_repeat(F.lit(IGNORE_INDEX), F.lit(T) - used))
    return F.struct(ids.alias("input_ids"), attn.alias("attention_mask"), labels.alias("labels"))


def count_id(ids, token_id) -> Column:
    """Occurrences of one id in an id array."""
    return F.size(F.filter(_c(ids), lambda x: x == _lit(token_id)))


def placeholder_counts(ids, markers: dict[str, int]) -> Column:
    """SEQ-06: struct of per-marker occurrence counts (markers absent from
    the vocabulary are simply not passed)."""
    return F.struct(*[count_id(ids, v).alias(k) for k, v in markers.items()])


def grid_tokens(grid) -> Column:
    """SEQ-07: sum over grids of T*H*W (``grid`` is array<array<int>>)."""
    return F.aggregate(_c(grid), F.lit(0).cast("bigint"),
                       lambda acc, g: acc + F.aggregate(g, F.lit(1).cast("bigint"), lambda p, x: p * x))


def visual_tokens(h, w, patch: int = 28) -> Column:
    """SEQ-07: ceil(H / 28) * ceil(W / 28)."""
    return (F.ceil(_c(h) / F.lit(patch)) * F.ceil(_c(w) / F.lit(patch))).cast("bigint")


def domain_argmax(scores, start, size) -> Column:
    """SEQ-09: arg-max over the row's domain classes (global indices
    ``start .. start+size-1``); the first index wins ties; no domain -> -1."""
    s = F.slice(_c(scores), _c(start) + 1, _c(size))
    pos = F.array_position(s, F.array_max(s))
    return F.when(_c(start).isNull() | (_c(size) <= 0), F.lit(-1).cast("bigint")) \
            .otherwise((pos - 1 + _c(start)).cast("bigint"))
