"""Fill-in-middle: texts are cut at line ends found eight bytes at a time, and put in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapecheck.llm.text import bodies, byte_slices

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_SEVEN, _EIGHT = np.uint64(7), np.uint64(8)


@dataclass(frozen=True)
class Cutting:
    """The seed of the draws, the share of texts that are cut, the share of those in suffix-first
    form (both in percent), and the three marks."""

    seed: int = 7
    cut_percent: int = 100
    suffix_first_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words of eight, zeros appended."""
    padded = np.zeros(-(-(len(data) + 1) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``; no carry leaves a byte, so the marks are exact."""
    x = words ^ (_ONES * np.uint64(byte))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def continuation_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that continues a UTF-8 character (10xxxxxx)."""
    return words & ~(words << np.uint64(1)) & _HIGH


class Marks:
    """Rank and select over marked bytes: a count for every word, running totals, and the rest inside one word."""

    def __init__(self, marked: np.ndarray):
        self.marked = marked
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marked), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte offset."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        inside = self.marked[word] & ((np.uint64(1) << (byte * _EIGHT)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the mark with each number, counted from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        rest = (k - self.before[word]).astype(np.uint64)
        up_to = (self.marked[word] >> _SEVEN) * _ONES  # each byte: marks up to and with it
        passed = ((rest * _ONES | _HIGH) - up_to) & _HIGH  # bytes with at most `rest` of them
        return word * 8 + np.bitwise_count(passed)


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that follow from the seed and the id alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


#: Bytes of output that are handed on at once.
BATCH_BYTES = 8 << 20


def _cut(body: np.ndarray, at: np.ndarray, ids: list[int | None], how: Cutting) -> dict[str, list]:
    words = as_words(body)
    ends, inner = Marks(equal_bytes(words, 0x0A)), Marks(continuation_bytes(words))
    begin, stop = at[:-1], at[1:]
    first = ends.rank(begin)
    lines = ends.rank(stop) - first
    filled = stop > begin
    open_end = filled.copy()
    open_end[filled] = body[stop[filled] - 1] != 0x0A  # the last line may lack its end
    n = lines + open_end
    h = np.array([draws(how.seed, i) for i in ids], np.int64).reshape(len(ids), 4)
    picks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)

    def after(units: np.ndarray) -> np.ndarray:
        """Byte offset after so many units of each text."""
        out = np.where(units == n, stop, begin)
        some = (units > 0) & (units < n)
        out[some] = ends.select((first + units - 1)[some]) + 1
        return out

    one, two = after(picks[:, 0]), after(picks[:, 1])
    chars = lambda a, b: (b - a) - (inner.rank(b) - inner.rank(a))
    prefix_chars, middle_chars = chars(begin, one), chars(one, two)
    p, s, m = how.marks
    raw = body.tobytes()
    out: dict[str, list] = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
    for i in range(len(ids)):
        text = raw[begin[i] : stop[i]]
        plain = not text or h[i, 2] % 100 >= how.cut_percent or p in text or s in text or m in text
        form = "plain" if plain else "spm" if h[i, 3] % 100 < how.suffix_first_percent else "psm"
        if not plain:
            a, b = one[i] - begin[i], two[i] - begin[i]
            head, mid, tail = text[:a], text[a:b], text[b:]
            text = b"".join((s, tail, p, head, m, mid) if form == "spm" else (p, head, s, tail, m, mid))
        out["n"].append(int(n[i]))
        out["form"].append(form)
        out["prefix_chars"].append(None if plain else int(prefix_chars[i]))
        out["middle_chars"].append(None if plain else int(middle_chars[i]))
        out["output"].append(text)
    return out


def fill_in_middle(docs: DataFrame, how: Cutting = Cutting()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    A text of ``n`` lines (each with its line feed; the last may lack it) is cut after two
    numbers of lines drawn from ``how.seed`` and ``doc_id`` into prefix, middle and suffix,
    and written as ``<P>prefix<S>suffix<M>middle`` (``psm``) or ``<S>suffix<P>prefix<M>middle``
    (``spm``). Lengths count code points. Nothing is shuffled; the texts of an Arrow batch are
    viewed together as 64-bit words, line ends are marked by arithmetic on whole words and
    counted by word, and the wanted ends are found by a search in the running counts and a
    selection inside one word. Handed on in bounded batches, so memory follows the longest text.

    A NULL or empty text, and one that holds one of the marks, stays as it is (``plain``, NULL lengths).
    A NULL ``doc_id`` draws from the seed alone. Rows that repeat are cut alike. Extra
    columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = bodies(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for start, stop in byte_slices(at, BATCH_BYTES):
                part = at[start : stop + 1]
                out = _cut(body[part[0] : part[-1]], part - part[0], ids[start:stop], how)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[start:stop], pa.int64()),
                        pa.array(out["n"], pa.int64()),
                        pa.array(out["form"], pa.string()),
                        pa.array(out["prefix_chars"], pa.int64()),
                        pa.array(out["middle_chars"], pa.int64()),
                        pa.array(out["output"], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def restored(output: bytes, form: str, how: Cutting = Cutting()) -> bytes:
    """The text that was cut. Marks occur once each, since texts that hold one are not cut."""
    if form == "plain":
        return output
    p, s, m = how.marks
    rest, middle = output.rsplit(m, 1)
    if form == "psm":
        head, tail = rest[len(p) :].split(s, 1)
    else:
        tail, head = rest[len(s) :].split(p, 1)
    return head + middle + tail


def with_restored(cut: DataFrame, how: Cutting = Cutting()) -> DataFrame:
    """The rows of :func:`fill_in_middle` with ``text``, rebuilt from ``output`` and ``form`` alone."""
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = bodies(batch.column("output"))
            for start, stop in byte_slices(at, BATCH_BYTES):
                part = batch.slice(start, stop - start)
                outputs, forms = part.column("output").cast(pa.binary()).to_pylist(), part.column("form").to_pylist()
                texts = [restored(o, f, how) for o, f in zip(outputs, forms)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return cut.mapInArrow(run, f"{fields}, text string")
