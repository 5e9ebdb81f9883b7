"""Text expressions: tokens, hashed features, search normalisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from quire.functions.binding import bind, runs_of

# The stop list decides which words count as content.
STOP_WORDS = (
    "a an and are as at be but by can could do does did for from had has have "
    "how i if in into is it its may me my of on or our shall should so than that "
    "the their them then there these they this to under upon was we were what "
    "when where which who whom will with would you your"
).split()

TOKEN_PATTERN = "[a-z0-9']+"
FEATURE_DIMS = 512

# The characters that count as white space when spans are trimmed.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def tokens(text: Column) -> Column:
    """Lower-case content words of ``text``, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def token_hash(token: Column) -> Column:
    """First 32 bits of the md5 digest as an unsigned number."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")


def token_counts(words: Column) -> Column:
    """Distinct tokens with their counts, as array<struct<token,n>>, sorted."""
    return bind(
        F.sort_array(words),
        lambda s: F.transform(
            runs_of(s, lambda a, b: a == b),
            lambda r: F.struct(F.get(s, r["at"]).alias("token"), r["n"].alias("n")),
        ),
    )


def hash_features(words: Column, dims: int = FEATURE_DIMS) -> Column:
    """Signed, hashed, log-weighted token counts as array<struct<bucket,weight>>.

    Everything happens inside the row: sort, run lengths, sort by bucket, sum.
    No exchange is needed because a chunk never leaves its row.
    """

    # A bucket above 32 bits that hold the signed count: whole numbers sort faster than structs do,
    # and in the order of their weights. Hashes come first, so that each is made once.
    coded = lambda h, n: F.shiftleft(F.pmod(h, F.lit(dims)), 32) + F.when(h >= 2**31, n).otherwise(-n) + 2**31
    bucket = lambda c: F.shiftright(c, 32).cast("int")

    def weight(c: Column) -> Column:
        n = c.bitwiseAND(F.lit(2**32 - 1)) - 2**31
        return F.signum(n) * (F.log(F.abs(n).cast("double")) + 1.0)

    def codes(counted: Column) -> Column:
        return bind(
            F.transform(counted, lambda t: token_hash(t["token"])),
            lambda hashes: F.sort_array(F.transform(hashes, lambda h, i: coded(h, F.get(counted, i)["n"]))),
        )

    def summed(s: Column, r: Column) -> Column:
        return F.aggregate(F.slice(s, r["at"] + 1, r["n"]), F.lit(0.0), lambda acc, c: acc + weight(c))

    def by_bucket(s: Column) -> Column:
        # Most buckets have one token, whose weight is the sum.
        return F.transform(
            runs_of(s, lambda a, b: F.shiftright(a, 32) == F.shiftright(b, 32)),
            lambda r: F.struct(
                bucket(F.get(s, r["at"])).alias("bucket"),
                F.when(r["n"] == 1, weight(F.get(s, r["at"]))).otherwise(summed(s, r)).alias("weight"),
            ),
        )

    return bind(bind(token_counts(words), codes), by_bucket)


def l2_normalize(features: Column) -> Column:
    """Unit-length copy of sparse ``features``; a zero vector stays zero."""

    def scaled(f: Column) -> Column:
        length = F.sqrt(F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x["weight"] * x["weight"]))
        return bind(
            bind(length, lambda n: F.when(n > 0, n).otherwise(F.lit(1.0))),
            lambda norm: F.transform(
                f,
                lambda x: F.struct(
                    x["bucket"].alias("bucket"), (x["weight"] / norm).alias("weight")
                ),
            ),
        )

    return bind(features, scaled)


def dense_vector(features: Column, dims: int = FEATURE_DIMS) -> Column:
    """Sparse features, sorted by bucket as :func:`hash_features` gives them, as array<double> of length ``dims``."""

    def written(f: Column) -> Column:
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        last = lambda i: F.coalesce(F.get(f, i)["bucket"], F.lit(-1))
        filled = F.transform(f, lambda x, i: F.concat(zeros(x["bucket"] - last(i - 1) - 1), F.array(x["weight"])))
        return F.flatten(F.concat(filled, F.array(zeros(F.lit(dims - 1) - last(F.size(f) - 1)))))

    return bind(features, written)


# Characters a search ignores, and the ones it folds to ASCII.
INVISIBLE = "­​‌‍⁠﻿"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"
DASHES = "‐‑‒–—―−"

# Characters compatibility normalisation leaves alone in any combination with
# each other, so text made only of these skips the Python step.
STABLE_TEXT = r"\A[\x00-\x7fÀ-ı‐‒-―‘-‟]*\z"


def compatibility_form(text: Column) -> Column:
    """NFKC. Only rows that could change are shipped to Python."""

    # Nested, so that it is shipped whole and executors need no package install.
    def nfkc(column: pd.Series) -> pd.Series:
        from unicodedata import normalize

        return column.map(lambda t: None if t is None else normalize("NFKC", t))

    unstable = F.when(~F.regexp_like(text, F.lit(STABLE_TEXT)), text)
    return F.coalesce(F.pandas_udf(nfkc, "string")(unstable), text)


def fold_for_search(text: Column) -> Column:
    """Everything :func:`normalize_for_search` does after NFKC, all built-ins."""
    plain = F.translate(
        text,
        SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + INVISIBLE,
        "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES),
    )
    return F.lower(F.regexp_replace(plain, r"(?U)\s+", ""))


def normalize_for_search(text: Column) -> Column:
    """Loose form used by the leak check: no blanks, no case, plain punctuation."""
    return fold_for_search(compatibility_form(text))


def strip_space(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))
