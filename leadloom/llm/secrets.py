"""Secret scan: keyword automaton first, anchored patterns only near its hits, then checksums.

An Aho-Corasick automaton over the ASCII-lower-cased text finds the keywords of all rules in one
pass; each rule's pattern is matched only at the place its keyword fixes. Runs of hexadecimal
digits have no keyword: every run of 32 covers a position that is a multiple of 32, so only those
positions are probed, and runs are read out around the probes that hit. Tokens with an embedded
checksum (``ghp_`` and its kin, ``npm_``: the last 6 characters are the CRC-32 of the 30 before
them in base 62) are reported only if it fits.

Defined results: null text is empty and has no spans; repeated rows get equal results; extra
columns are not read; an empty table gives no rows. Patterns consume characters without going
back, so very long texts take linear time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# The value stops at the first character outside its class; matching never returns into it.
ASSIGN = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]+")
CHECKED = {"ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "npm_": "registry"}
CHECKED_BODY = re.compile(r"[A-Za-z0-9]+")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LEAST = 32


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in CHECKED:
        found.add_word(word, (word, len(word)))
    found.make_automaton()
    return found


def checksum_fits(body: str) -> bool:
    """30 characters and the base-62 digits of their CRC-32."""
    if len(body) != 36:
        return False
    rest, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = DIGITS62[digit] + digits
    return digits == body[30:]


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of lower-case hexadecimal digits of 32 or more."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    probes = codes[HEX_LEAST - 1 :: HEX_LEAST]
    hits = np.flatnonzero(((probes >= 48) & (probes <= 57)) | ((probes >= 97) & (probes <= 102)))
    done = 0
    for at in (hits * HEX_LEAST + HEX_LEAST - 1).tolist():
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in "0123456789abcdef":
            start -= 1
        done = HEX_RUN.match(text, at).end()
        if done - start >= HEX_LEAST:
            yield start, done


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, base kinds leftmost and without overlap within a kind."""
    lower = text.encode().lower().decode()  # only A-Z change, so places stay
    found = [(a, b, "hex") for a, b in hex_runs(text)]
    done = dict.fromkeys((*BASE, "checked"), 0)
    hits = sorted((end + 1 - length, -length, kind) for end, (kind, length) in automaton().iter(lower))
    for start, length, kind in hits:
        end = start - length
        if kind == "assign":
            if start < done["assign"] or not (m := ASSIGN.match(text, end)):
                continue
            done["assign"] = m.end()  # a match that fails its check is used up too
            if len(m[1]) >= 8:
                found.append((start, m.end(), "assign"))
        elif kind == "access":
            if start < done["access"] or not (m := ACCESS.match(text, start)):
                continue
            done["access"] = m.end()
            if m.end() - start >= 16:
                found.append((start, m.end(), "access"))
        elif text.startswith(kind, start) and start >= done["checked"]:
            m = CHECKED_BODY.match(text, end)
            if m and checksum_fits(m[0]):
                found.append((start, m.end(), CHECKED[kind]))
                done["checked"] = m.end()
    return found


def written_out(found: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the given order."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted((x for x in found if x[2] in rank), key=lambda x: (x[0], rank[x[2]], x[1])))


KINDS = (*BASE, "forge", "registry")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, found`` for every row: found is an array of (start, end, kind, secret)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("secret", pa.string())]))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = sorted(spans(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                rows.append([{"start": a, "end": b, "kind": k, "secret": text[a:b]} for a, b, k in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type_)], ["doc_id", "found"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<start: bigint, end: bigint, kind: string, secret: string>>")


def digests(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """Counts per base kind, hash of the base spans and all spans as text."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of_base = F.filter("found", lambda x: x["kind"].isin(*base))
    of_kind = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(of_base, one), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", one), ",").alias("spans"),
    )
