"""Fill-in-middle transformation on ropes.

A rope is a balanced tree over pieces of a text. Every leaf and node caches how many units (lines) and code points it holds,
so a tree is split at a unit rank or at a code point rank by one walk from the root, and pieces are put together in another
order without copying them. Marks are leaves of their own that hold no unit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ._common import small_batches

#: Code points from which on a leaf ends at the next end of a unit.
LEAF = 2048
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")

FORMED = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text) or a node (left, right) with its caches. None stands for the empty rope."""

    units: int
    points: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


def leaf(text: str, units: int) -> Rope | None:
    return Rope(units, len(text), 0, text) if text else None


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.points + b.points, 1 + max(a.height, b.height), "", a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node over two ropes whose heights differ by 2 at most, rotated where they do."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def join(a: Rope | None, b: Rope | None) -> Rope | None:
    """a, then b; walks down the edge of the taller one, so it costs the difference of their heights."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return _node(a, b)


def rope(text: str, size: int = LEAF) -> Rope | None:
    """The rope of a text. Leaves end with a unit; a long unit is a leaf of its own. Units are counted, never listed."""
    pieces: list[Rope] = []
    at = 0
    while at < len(text):
        end = text.find("\n", at + size - 1) + 1 or len(text)
        pieces.append(Rope(text.count("\n", at, end) + (text[end - 1] != "\n"), end - at, 0, text[at:end]))
        at = end

    def over(lo: int, hi: int) -> Rope:
        mid = (lo + hi) // 2
        return pieces[lo] if hi - lo == 1 else _node(over(lo, mid), over(mid, hi))

    return over(0, len(pieces)) if pieces else None


def split_units(r: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The first `rank` units and the rest."""
    if r is None or rank <= 0:
        return None, r
    if rank >= r.units:
        return r, None
    if r.left is not None:
        if rank <= r.left.units:
            a, b = split_units(r.left, rank)
            return a, join(b, r.right)
        a, b = split_units(r.right, rank - r.left.units)
        return join(r.left, a), b
    at = -1
    for _ in range(rank):
        at = r.text.index("\n", at + 1)
    return leaf(r.text[: at + 1], rank), leaf(r.text[at + 1 :], r.units - rank)


def split_points(r: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The first `rank` code points and the rest. A unit that is cut counts for the part with its end."""
    if r is None or rank <= 0:
        return None, r
    if rank >= r.points:
        return r, None
    if r.left is not None:
        if rank <= r.left.points:
            a, b = split_points(r.left, rank)
            return a, join(b, r.right)
        a, b = split_points(r.right, rank - r.left.points)
        return join(r.left, a), b
    ended = r.text.count("\n", 0, rank)
    return leaf(r.text[:rank], ended), leaf(r.text[rank:], r.units - ended)


def leaves(r: Rope | None) -> Iterator[str]:
    waiting = [r] if r is not None else []
    while waiting:
        x = waiting.pop()
        if x.left is None:
            yield x.text
        else:
            waiting += [x.right, x.left]


def text_of(r: Rope | None) -> str:
    return "".join(leaves(r))


def rank_of(r: Rope | None, mark: str) -> int:
    """Code point rank of the first occurrence of a mark, or -1. Leaves are searched one by one, with what the mark's length
    can reach back into the one before."""
    done, tail = 0, ""
    for piece in leaves(r):
        found = (tail + piece).find(mark)
        if found >= 0:
            return done - len(tail) + found
        done += len(piece)
        tail = (tail + piece)[-(len(mark) - 1) :] if len(mark) > 1 else ""
    return -1


def rearranged(text: str, first: int, second: int, form: str, marks: tuple[str, str, str] = MARKS) -> tuple[str, int, int]:
    """The text with its middle moved to the end, and the code points of prefix and middle. Prefix and middle end after the
    given numbers of units."""
    whole = rope(text)
    prefix, rest = split_units(whole, first)
    middle, suffix = split_units(rest, second - first)
    p, s, m = (leaf(x, 0) for x in marks)
    pieces = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out: Rope | None = None
    for x in pieces:
        out = join(out, x)
    return text_of(out), prefix.points if prefix else 0, middle.points if middle else 0


def inverted(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that `rearranged` was given, from its output and form alone. No piece holds a mark, and no mark is the end of
    another's beginning, so a mark's first occurrence is its place."""
    if form == "plain":
        return output
    first, second, last = (marks[1], marks[0], marks[2]) if form == "spm" else marks
    tree = rope(output)
    _, tree = split_points(tree, len(first))
    one, tree = split_points(tree, rank_of(tree, second))
    _, tree = split_points(tree, len(second))
    two, tree = split_points(tree, rank_of(tree, last))
    _, middle = split_points(tree, len(last))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return text_of(join(join(prefix, middle), suffix))


def _raw(rows: pa.StructArray, name: str) -> list[bytes]:
    """UTF-8 bytes of a string field, null as empty."""
    return [x or b"" for x in rows.field(name).cast(pa.binary()).to_pylist()]


def form_texts(docs: DataFrame, seed: int = 7, share: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with all their columns and n (lines), form, prefix_chars, middle_chars, output.

    docs: doc_id, text; columns of the new names are replaced. A document's four numbers are the first four groups of eight
    digits of the hexadecimal SHA-256 of `seed:doc_id` (null: nothing after the colon), so reruns and rows with equal doc_ids
    agree. The prefix ends after the smaller of the first two modulo n + 1 lines, the middle after the larger. The form is plain
    if the text is empty, holds one of the marks, or the third number modulo 100 is `share` or more; else spm if the fourth
    modulo 100 is below `spm`, else psm. Output: the text if plain; prefix, suffix, middle, each after its mark, for psm; suffix,
    prefix, middle for spm. prefix_chars and middle_chars are code points, null if plain.

    Null texts are empty, empty texts plain; equal draws make an empty middle; long texts are cut into leaves, so a split looks at
    one leaf, however many lines there are; repeated rows give equal rows; an empty table gives none. Bytes that are no UTF-8
    are kept. Rows are formed where they are read, without a shuffle.
    """
    if any(x[:k] == x[-k:] for x in marks for k in range(1, len(x))) or not all(marks):
        raise ValueError("a mark must not be empty or end as it begins")
    small_batches(docs.sparkSession)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*(F.conv(F.substring(hashed, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)))

    def form(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for raw, (h1, h2, h3, h4) in zip(_raw(batch["row"], "text"), batch["draws"].to_pylist()):
                text = raw.decode("utf-8", "surrogateescape")
                n = text.count("\n") + (text[-1:] not in ("", "\n"))
                if not text or any(x in text for x in marks) or h3 % 100 >= share:
                    new.append((n, "plain", None, None, raw))
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                kind = "spm" if h4 % 100 < spm else "psm"
                out, prefix, middle = rearranged(text, first, second, kind, marks)
                new.append((n, kind, prefix, middle, out.encode("utf-8", "surrogateescape")))
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array([x[k] for x in new], f.type) for k, f in enumerate(FORMED))], ["row", *FORMED.names])

    rows = docs.select(F.struct(*docs.columns).alias("row"), draws.alias("draws"))
    out = StructType([rows.schema["row"], *(StructField(f.name, k) for f, k in zip(FORMED, (LongType(), StringType(), LongType(), LongType(), BinaryType())))])
    formed = rows.mapInArrow(form, out)
    others = (F.col("row")[c].alias(c) for c in docs.columns if c not in FORMED.names)
    return formed.select(*others, "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore_texts(formed: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """formed (output, form, and any other columns) with `restored`: the exact text that was formed, from these two columns alone.

    Null outputs count as empty, and a form other than psm and spm, null too, as plain; a column `restored` is replaced; repeated
    rows give equal rows; an empty table gives none.
    """
    small_batches(formed.sparkSession)

    def restore(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = []
            for raw, kind in zip(_raw(batch["row"], "output"), batch["row"].field("form").to_pylist()):
                back.append(inverted(raw.decode("utf-8", "surrogateescape"), kind, marks).encode("utf-8", "surrogateescape") if kind in ("psm", "spm") else raw)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(back, pa.binary())], ["row", "restored"])

    rows = formed.select(F.struct(*formed.columns).alias("row"))
    out = rows.mapInArrow(restore, StructType([*rows.schema, StructField("restored", BinaryType())]))
    return out.select(*(F.col("row")[c].alias(c) for c in formed.columns if c != "restored"), F.col("restored").cast("string").alias("restored"))
