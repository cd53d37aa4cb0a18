"""Fill-in-middle: texts cut at two unit boundaries and put around sentinels.

One match of ``(unit)*`` over the whole text keeps every repetition of its group, so
the ends of the captures give the number of units and both cuts without a loop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.common import batches_of, digest, extended

#: A line with its break, or what follows the last break.
UNIT = r"[^\n]*\n|[^\n]+"
#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Per cent of the documents that are cut, and of these the ones whose suffix comes first.
RATE = 100
SPM_RATE = 50
#: Characters of the texts that are rearranged at a time; a longer text is alone.
CHUNK = 1 << 22
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def cut(units: regex.Pattern, text: str, draws: Sequence[int]) -> tuple[int, int, int]:
    """Number of units of ``text``, and where prefix and middle end, in code points.

    ``units`` must match any text as a whole, as ``(unit)*`` with group 1.
    """
    ends = [0, *units.fullmatch(text).ends(1)]
    first, last = sorted(d % len(ends) for d in draws)
    return len(ends) - 1, ends[first], ends[last]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = UNIT, sentinels: Sequence[str] = SENTINELS
) -> DataFrame:
    """Adds ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to ``docs``.

    Which documents are cut, where, and in which form follows from the SHA-256 of seed
    and ``doc_id`` alone, so a repeated task gives the same rows. ``form`` is ``psm``
    (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: the text as
    it is, for empty texts, those with a sentinel and those not drawn; both lengths are
    null then. Null text is empty; a null ``doc_id`` is drawn like an empty one. Rows of
    equal id are drawn alike. Extra columns stay; one named like a new column is replaced.
    A text takes about 200 bytes of memory a line while it is matched.
    """
    p, s, m = sentinels

    def rearranged(doc_id, text: str) -> tuple:
        drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(drawn[8 * i : 8 * i + 8], 16) for i in range(4))
        n, a, b = cut(units, text, (h1, h2))
        if not text or h3 % 100 >= rate or any(x in text for x in sentinels):
            return n, "plain", None, None, text
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    schema = extended(docs.schema, ADDED)
    kept = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    units = regex.compile(f"({unit})*")

    def run(batches):
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            for rows in batches_of(range(len(texts)), CHUNK, lambda i: len(texts[i])):
                new = zip(*(rearranged(ids[i], texts[i]) for i in rows))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                own = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in kept), *(pa.array(v, t) for v, t in zip(new, types))], schema.names
                )

    return docs.select(*kept).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` has made ``output`` of.

    Texts with a sentinel are never cut, so the three sentinels part the output.
    """
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in sentinels), -1)
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def query(docs: DataFrame) -> DataFrame:
    done = fill_in_middle(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
