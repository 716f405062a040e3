"""Quality rules by compression bands.

A text's bytes are compressed with zstandard as a whole and in fixed chunks. Repetitive text
compresses too well, noise too little. Short texts compress worse than long ones, so each
power-of-two length class has its own band; chunks are judged by the band of the chunk's length.
A text is kept when its whole ratio lies in its band and at most ``bad_chunks`` of its chunks lie
outside theirs.

Cases: null and empty texts have no words and fail the base rule; repeated rows are judged alike;
columns of the input other than the id and text are not read. Ratio = bytes / compressed bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from regionmatch.llm import text as t

CHUNK = 4096
LEVEL = 3
#: Ratio bands by length class: (bytes below, least, most). Clean prose of any length lies well inside; fixed values.
BANDS = (
    (64, 0.0, 1.6), (128, 0.8, 1.9), (256, 0.95, 2.2), (512, 1.1, 2.3), (1024, 1.25, 2.4), (2048, 1.35, 2.7), (4096, 1.45, 3.0),
    (16384, 1.5, 3.5), (1 << 62, 1.5, 4.0),
)
BAD_CHUNKS = 0.34
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, bad_chunks double")


def in_band(size: int, packed: int, bands=BANDS) -> bool:
    least, most = next((lo, hi) for below, lo, hi in bands if size < below)
    return least <= size / packed <= most


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return hit


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    hit = np.zeros(len(keys), bool)
    hit[order[1:]] = s[1:] == s[:-1]
    return hit


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The plain counts of each row of a slice."""
    n = len(offsets) - 1
    starts, ends, row = t.words(data, offsets)
    out = {"n_words": np.bincount(row, minlength=n)}
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["word_chars"] = np.bincount(row, points[ends] - points[starts], n).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_symbols"] = marks[offsets[1:]] - marks[offsets[:-1]]
    w = t.rolling(t.hashes(data, starts, ends), window)
    inside = t.whole(row, window)
    at = np.flatnonzero(inside)
    salt = t.mix(row[at].astype(np.uint64) + t.U(1))
    hit = at[_repeated(w[at] ^ salt)]
    in_repeat = t.covered(len(starts), hit, np.full(len(hit), window))
    out["n_repeat_words"] = np.bincount(row[in_repeat], minlength=n)
    # lines: between line feeds, inside a row
    feeds = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    ls = ls[ls < len(data)]
    lrow = np.searchsorted(offsets, ls, "right") - 1
    le = np.minimum(np.concatenate([ls[1:], [len(data)]]), offsets[lrow + 1]) if len(ls) else ls
    le = le - ((le > ls) & (data[np.maximum(le - 1, 0)] == 10)) if len(ls) else le
    wordy = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lrow = ls[wordy], le[wordy], lrow[wordy]
    dup = _later(t.hashes(data, ls, le) ^ t.mix(lrow.astype(np.uint64) + t.U(1)))
    out["n_dup_lines"] = np.bincount(lrow[dup], minlength=n)
    return out


def verdict(raw: bytes, packer: zstandard.ZstdCompressor, chunk: int = CHUNK, bands=BANDS, most_bad: float = BAD_CHUNKS) -> tuple[bool, float, float]:
    """(within limits, whole ratio, share of chunks outside their band)."""
    if not raw:
        return False, 0.0, 0.0
    packed = len(packer.compress(raw))
    if len(raw) <= chunk:
        return in_band(len(raw), packed, bands), len(raw) / packed, 0.0
    parts = [raw[i:i + chunk] for i in range(0, len(raw), chunk)]
    bad = sum(not in_band(len(p), len(packer.compress(p)), bands) for p in parts) / len(parts)
    return in_band(len(raw), packed, bands) and bad <= most_bad, len(raw) / packed, bad


def compression_bands(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, level: int = LEVEL, bands=BANDS, most_bad: float = BAD_CHUNKS) -> DataFrame:
    """Counts, base rule and band verdict of every row; one narrow pass, no exchange."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=level)
        for rows, data, offsets in t.slices(batches, "text"):
            c = base_counts(data, offsets)
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            judged = [verdict(data[a:b].tobytes(), packer, chunk, bands, most_bad) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(0), **{k: c[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
                "base_failed": failed, "kept": np.array([j[0] for j in judged], bool) & ~failed,
                "ratio": [j[1] for j in judged], "bad_chunks": [j[2] for j in judged],
            })

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return picked.mapInArrow(run, SCHEMA)
