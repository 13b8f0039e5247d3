"""SentencePiece encoding and decoding by a streaming Viterbi search.

The pieces come from a public model file, which the driver reads and broadcasts
(its size is that of the vocabulary). Among all ways to cut a text into pieces the
one with the largest sum of log-probabilities is taken; of equal sums, the one
whose last piece is longer (so for every prefix). A model of merges has ranks, not probabilities; there
a piece of rank r has probability in proportion to 1 / (r + 10). A character that
no piece covers falls back to byte pieces.

The search keeps a window of as many positions as the longest piece has
characters. Whenever the backpointer paths of all positions in the window run
through one boundary, the ids up to it are committed and forgotten, so memory does
not grow with the text. Should paths not converge (one character repeated over and
over), their backpointers are kept until they do, and convergence is looked for each
time the window has doubled, so time stays in proportion to the text. Where no piece crosses a boundary (before a space, at a
line feed, from a letter to a sign) paths always converge; equal stretches between such boundaries have
equal ids, which a bounded memo uses.

Decoding is exact for every text: spaces are only ever encoded by pieces, no space
is added or dropped, and the space mark itself, if a text has it, goes through
byte pieces. Null and empty texts have no ids; ids that are null decode to null; ids
beyond the vocabulary, and bytes that are no UTF-8, decode to U+FFFD; control ids to
nothing. Rows are independent, so repeated rows and ties do not matter; very long texts
are encoded whole; empty tables give empty ones; other columns are ignored.

Ids are those of the best path under these probabilities, without a space put before
the text; a model of merges, applied merge by merge, cuts some words otherwise.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Log-probabilities are whole multiples of 1 / SCALE, so sums are exact and ties are ties.
SCALE = 1 << 20
BYTE_LOG_P = -30 * SCALE
UNREACHED = -(1 << 62)
#: Stretches of each of the memo's two generations, and the longest stretch that is searched whole and remembered.
MEMO, SHORT = 150_000, 64
LETTER, SIGN = r"[A-Za-z\u00C0-\u024F]", r"[^\w \n]"


@dataclass
class Pieces:
    """A vocabulary: log-probability and id of each piece, and what each id decodes to."""

    log_p: dict[str, tuple[int, int]]
    prefixes: dict[str, tuple[int, int] | None]  # log_p, and None for what is only the beginning of pieces
    byte_ids: list[int]
    decoded: list[bytes]
    longest: int
    splits: bool  # no piece has a space after another character, or a line feed
    signs: bool  # no piece has a sign after a Latin letter
    memo: dict[str, bytes] = field(default_factory=dict)
    before: dict[str, bytes] = field(default_factory=dict)  # the memo's older generation: what is used again moves on

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "before": {}}


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    log_p, byte_ids, decoded = {}, [-1] * 256, []
    scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
    ranked = all(s == round(s) for s in scores)
    for i, score in enumerate(scores):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            decoded.append(b"")
        else:
            text = piece.replace(MARK, " ")
            decoded.append(text.encode())
            log_p[text] = (round(SCALE * (-math.log(10.0 - score) if ranked else score)), i)
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    splits = not any(re.search(r"[^ ] |\n", p) for p in log_p)
    signs = not any(re.search(LETTER + SIGN, p) for p in log_p)
    prefixes: dict[str, tuple[int, int] | None] = {p[:k]: None for p in log_p for k in range(1, len(p))}
    return Pieces(log_p, prefixes | log_p, byte_ids, decoded, max(map(len, log_p)), splits, signs)


def viterbi(text: str, p: Pieces) -> Iterator[list[int]]:
    """Committed runs of ids, in order; the state is bounded by the longest piece."""
    longest, step, n = p.longest, p.prefixes, len(text)
    base = 0  # the boundary up to which ids are committed; the lists begin there
    check = 2 * longest  # the window's size at which convergence is looked for
    score: list[int | None] = [0]
    back: list[tuple[int, tuple[int, ...]] | None] = [None]  # where the best last piece begins, and its ids
    for k in range(n + 1):
        at = k - base
        if at and (at == len(score) or score[at] is None):  # no piece ends here
            raw = text[k - 1].encode("utf-8", "surrogatepass")
            if at == len(score):
                score.append(None)
                back.append(None)
            score[at], back[at] = score[at - 1] + BYTE_LOG_P * len(raw), (k - 1, tuple([p.byte_ids[b] for b in raw]))
        if k == n or at >= check:
            # All paths on from here run through position k or a piece that spans it.
            live = {k} if k == n else {k, *(b[0] for b in back[at + 1 :] if b is not None)}
            while len(live) > 1:
                top = max(live)
                live.remove(top)
                live.add(back[top - base][0])
            cut = here = live.pop()
            run: list[int] = []
            while here > base:
                here, ids = back[here - base]
                run += reversed(ids)
            if run:
                yield run[::-1]
            del score[: cut - base], back[: cut - base]
            base = cut
            at = k - base
            if k == n:
                return
            check = 2 * max(longest, at)
        mine = score[at]
        for end in range(k + 1, min(n, k + longest) + 1):
            sub = text[k:end]
            if sub not in step:
                break
            hit = step[sub]
            if hit is not None:
                to = end - base
                while to >= len(score):
                    score.append(None)
                    back.append(None)
                old = score[to]
                if old is None or mine + hit[0] > old:
                    score[to], back[to] = mine + hit[0], (k, (hit[1],))


def short(text: str, p: Pieces) -> list[int]:
    """The ids of a short text, as :func:`viterbi` gives them, without its window."""
    get, longest, n = p.prefixes.get, p.longest, len(text)
    score, start, piece = [0] + [UNREACHED] * n, [0] * (n + 1), [-1] * (n + 1)
    for k in range(n + 1):
        mine = score[k]
        if mine == UNREACHED:  # no piece ends here
            mine = score[k] = score[k - 1] + BYTE_LOG_P * len(text[k - 1].encode("utf-8", "surrogatepass"))
            start[k] = k - 1
        for end in range(k + 1, min(n, k + longest) + 1):
            hit = get(text[k:end], 0)
            if hit:
                total = mine + hit[0]
                if total > score[end]:
                    score[end], start[end], piece[end] = total, k, hit[1]
            elif hit == 0:
                break
    out: list[int] = []
    while n:
        if piece[n] >= 0:
            out.append(piece[n])
        else:
            out += [p.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
        n = start[n]
    return out[::-1]


#: Stretches between boundaries that no piece crosses.
STRETCH = re.compile(r"\n| *[^ \n]+| +")
PART = re.compile(f"(?<={LETTER})(?={SIGN})")


def _ids(s: str, p: Pieces, parts: list[str]) -> bytes:
    """The ids of a stretch, through the memo."""
    got = p.memo.get(s)
    if got is None:
        got = p.before.get(s)
        if got is not None:
            pass
        elif len(parts) > 1:
            got = b"".join([_ids(x, p, [x]) for x in parts])
        elif len(s) <= SHORT:
            got = array("i", short(s, p)).tobytes()
        else:
            got = array("i", [i for run in viterbi(s, p) for i in run]).tobytes()
        if len(s) <= SHORT:
            if len(p.memo) >= MEMO:
                p.before, p.memo = p.memo, {}
            p.memo[s] = got
    return got


def encode(text: str | None, p: Pieces) -> array:
    out = array("i")
    if not text:
        return out
    memo = p.memo
    for s in STRETCH.findall(text) if p.splits else [text]:
        got = memo.get(s)
        if got is None:
            got = _ids(s, p, PART.split(s) if p.signs else [s])
        out.frombytes(got)
    return out


def decode(ids, p: Pieces) -> str:
    """The text of ids; what has no meaning becomes U+FFFD."""
    d, n = p.decoded, len(p.decoded)
    raw = b"".join([d[i] if 0 <= i < n else b"\xef\xbf\xbd" for i in ids])
    try:
        return raw.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


def decoded(rows: DataFrame, id_col: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row: doc_id and the text of its ids."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    own = rows.select(F.col(id_col).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [None if x is None else decode([-1 if i is None else i for i in x], p) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, ids, and whether they decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(1).to_pylist()
                each = [encode(t, p) for t in texts]
                exact = [decode(x, p) == (t or "") for x, t in zip(each, texts, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                flat = array("i")
                for x in each:
                    flat += x
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(exact)], ["doc_id", "ids", "exact"])

    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, ids array<int>, exact boolean")
