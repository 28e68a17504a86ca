"""Text column expressions: search text and character n-grams.

All functions return ``Column`` expressions that stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tokenizer: 4- and 5-character grams, lower-cased.
GRAM_SIZES = (4, 5)


def search_text(*cols: str | Column) -> Column:
    """``coalesce(c1,'') || ' ' || coalesce(c2,'') || ...``.

    Never NULL and always ``len(cols) - 1`` separators (unlike ``concat_ws``,
    which skips NULLs and changes the length of the text).
    """
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        c = F.col(c) if isinstance(c, str) else c
        parts.append(F.coalesce(c, F.lit("")))
    return F.concat(*parts)


def normalized(col: str | Column) -> Column:
    """The tokenizer's view of a value: lower-cased, NULL as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.coalesce(c, F.lit("")))


def gram_length(col: str | Column, sizes=GRAM_SIZES) -> Column:
    """Number of grams in a value (BM25 document length), closed form."""
    n = F.length(normalized(col))
    total = F.lit(0)
    for s in sizes:
        total = total + F.greatest(n - F.lit(s - 1), F.lit(0))
    return total


def _substring_at(t: Column, size: int):
    return lambda i: F.substring(t, i, size)


def _joined_at(chars: Column, size: int):
    return lambda i: F.concat(*[F.element_at(chars, i + F.lit(j)) for j in range(size)])


def ngrams(col: str | Column, sizes=GRAM_SIZES) -> Column:
    """Array of all grams (with repeats) of a short value, 4-grams then 5-grams.

    Uses ``substring`` per position, which is fine for names; for long text use
    :func:`ngrams_long`.  The ``len >= n`` guard matters: ``sequence(1, 0)``
    counts down.
    """
    t = normalized(col)
    n = F.length(t)
    arrays = []
    for s in sizes:
        arrays.append(
            F.when(
                n >= s,
                F.transform(F.sequence(F.lit(1), n - F.lit(s - 1)), _substring_at(t, s)),
            ).otherwise(F.array().cast("array<string>"))
        )
    return F.concat(*arrays)


def ngrams_long(col: str | Column, sizes=GRAM_SIZES) -> Column:
    """Grams of long text: split into characters once, then join neighbours.

    The character array is bound to a lambda variable (``transform`` over a
    one-element array) so it is computed once per value: referenced directly
    inside the per-position lambda, the split would be re-evaluated for every
    position, which is quadratic in the text length.  Element access in an
    array is constant time, so the whole is linear.
    """

    def from_chars(chars: Column) -> Column:
        n = F.size(chars)
        arrays = []
        for s in sizes:
            arrays.append(
                F.when(
                    n >= s,
                    F.transform(F.sequence(F.lit(1), n - F.lit(s - 1)), _joined_at(chars, s)),
                ).otherwise(F.array().cast("array<string>"))
            )
        return F.concat(*arrays)

    return F.element_at(F.transform(F.array(F.split(normalized(col), "")), from_chars), 1)


def query_grams(q: str | None, sizes=GRAM_SIZES) -> list[str]:
    """Distinct grams of one query string, in first-seen order.

    A parameter, not data: tokenizing the request string on the driver is the
    same as binding it in SQL.  Fewer than 4 characters gives no grams.
    """
    if not q:
        return []
    t = q.lower()
    out: list[str] = []
    for s in sizes:
        out.extend(t[i : i + s] for i in range(len(t) - s + 1))
    return list(dict.fromkeys(out))


def _regex_literal(g: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in g)


def gram_pattern(gram: str) -> str:
    """Java regex matching at every start position of ``gram`` (overlaps count)."""
    return f"(?={_regex_literal(gram)})"


def gram_count(col: str | Column, gram: str) -> Column:
    """Overlapping occurrences of ``gram`` in the normalized value.

    A zero-width lookahead counts every start position; the ``contains`` test
    skips the regex on rows without the gram.
    """
    t = normalized(col)
    return F.when(
        t.contains(F.lit(gram)), F.regexp_count(t, F.lit(gram_pattern(gram)))
    ).otherwise(F.lit(0))
