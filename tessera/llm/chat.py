"""Chat formatting with loss masks, by incremental rendering of a template that is a black box.

A template is any object whose render(messages) turns (role, text) pairs into one string. The span of a turn is found without looking inside:
the messages up to it are rendered, then those up to and with it, and the second output must begin with the first. A template whose
output does not begin so rewrites history (it drops earlier thoughts, say, or merges turns); such turns are reported.

Scale: conversations are sorted by turn within their hash partition and read as a stream. By default a conversation's own prefixes are rendered, all of
them, so the task holds one conversation, and its work grows with the square of the conversation's length. A template may declare (attribute lookback) how many earlier
turns a turn's output depends on. Only then prefixes are rendered in windows of WINDOW turns that begin with those turns, so that the
task holds a window, however long the conversation; where two windows meet, both must give the same output, or the turn counts as a rewrite.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
Message = tuple[str, str]


class TurnTemplate:
    """A heading line mark, role and text, an end mark. Backslashes and marks inside are escaped by a backslash, so parsing gives them back."""

    #: A turn's output depends on that turn alone.
    lookback = 0
    HEAD, SEP, END = "### ", ": ", " </turn>\n"
    _IN_TEXT, _IN_ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:")
    _UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
    _SEP = re.compile(r"(?:[^\\:]|\\(?:\\|###|</turn>|:))*: ")

    def render(self, messages: list[Message]) -> str:
        add = lambda m: "\\" + m.group()
        return "".join(f"{self.HEAD}{self._IN_ROLE.sub(add, r)}{self.SEP}{self._IN_TEXT.sub(add, t)}{self.END}" for r, t in messages)

    def parse(self, piece: str) -> tuple[str, str, int, int]:
        """Role and text of one rendered turn, and where its escaped text lies."""
        m = self._SEP.match(piece, len(self.HEAD))
        if not piece.startswith(self.HEAD) or m is None or not piece.endswith(self.END):
            raise ValueError("not one rendered turn")
        a, b = m.end(), len(piece) - len(self.END)
        plain = lambda s: self._UNESCAPE.sub(r"\1", s)
        return plain(piece[len(self.HEAD) : a - len(self.SEP)]), plain(piece[a:b]), a, b


def turn_spans(template, messages: list[Message]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The whole output, each turn's span in the output that ended with it, and the turns that rewrote what stood before."""
    before, spans, rewrites = "", [], []
    for k in range(len(messages)):
        out = template.render(messages[: k + 1])
        if out.startswith(before):
            spans.append((len(before), len(out)))
        else:
            rewrites.append(k)
            same = next((i for i, (a, b) in enumerate(zip(before, out, strict=False)) if a != b), min(len(before), len(out)))
            spans.append((same, len(out)))
        before = out
    return before, spans, rewrites


class _Windowed:
    """Renders a stream of turns with WINDOW turns held, and those that the template looks back on."""

    def __init__(self, template):
        self.template, self.held, self.out, self.keep = template, [], "", max(1, template.lookback)

    def add(self, message: Message) -> tuple[str, bool]:
        """The turn's piece of output, and whether history was rewritten."""
        new = self.template.render([*self.held, message])
        good = new.startswith(self.out)
        piece = new[len(self.out) :] if good else new
        self.held, self.out = [*self.held, message], new
        if len(self.held) > WINDOW + self.keep:
            last = self.held[-1 - self.keep : -1]
            base, again = self.template.render(last), self.template.render([*last, message])
            good &= again.startswith(base) and again[len(base) :] == piece
            self.held, self.out = [*last, message], again
        return piece, not good


_NAMES = ["conv_id", "turn", "place", "piece", "rewrites"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _format(template):
    def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def windowed(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, state, place = object(), None, 0
        for conv, turn, role, text in rows:
            if state is None or conv != now:
                now, state, place = conv, _Windowed(template), 0
            piece, rewrites = state.add((role or "", text or ""))
            yield conv, turn, place, piece, rewrites
            place += 1

    def whole(rows: Iterator[tuple]) -> Iterator[tuple]:
        def done(conv, talk) -> Iterator[tuple]:
            messages = [(r or "", t or "") for _, r, t in talk]
            out, spans, rewrites = turn_spans(template, messages)
            stands = bool(rewrites)
            for k, ((a, b), (turn, _, _)) in enumerate(zip(spans, talk, strict=True)):
                # After a rewrite only the whole output is the output; it is given with the last turn.
                yield conv, turn, k, (out[a:b] if not stands else out if k == len(talk) - 1 else ""), k in rewrites

        now, talk = object(), []
        for conv, turn, role, text in rows:
            if talk and conv != now:
                yield from done(now, talk)
                talk = []
            now = conv
            talk.append((turn, role, text))
        if talk:
            yield from done(now, talk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in (whole if getattr(template, "lookback", None) is None else windowed)(turns(batches)):
            held.append(row)
            size += len(row[3])
            if size > 4 << 20 or len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)

    return run


def format_conversations(turns: DataFrame, template) -> DataFrame:
    """conv_id, turn, place, piece, rewrites for each row of turns: its piece of the conversation's output, in order within the partition.

    Rows are ordered by turn (null first), then role, then text, so repeated and tied rows each stay a turn. A null role or text is empty; rows without conv_id
    make up one conversation; other columns are ignored; an empty table gives an empty result. A conversation's output is its pieces in order of place;
    rewrites tells that rendering a turn changed what stood before it.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(template), "conv_id long, turn long, place long, piece string, rewrites boolean")


def _digest(template: TurnTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        now, n, turns, loss, chars, total, done = object(), 0, None, None, 0, 0, []
        for batch in batches:
            for conv, place, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "piece")), strict=True):
                if place == 0:
                    if n:
                        done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    if len(done) >= 10_000:
                        yield flush()
                        done.clear()
                    now, n, turns, loss, chars, total = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                role, text, _, _ = template.parse(piece)
                turns.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    loss.update(text.encode())
                    chars += len(text)
                n += 1
                total += len(piece)
        if n:
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))
        if done:
            yield flush()

    return run


def read_back(formatted: DataFrame, template: TurnTemplate) -> DataFrame:
    """Per conversation what its output says: turns, their hash, the text under the loss mask (the assistant's), and the output's length.

    formatted: the partitions of format_conversations(); each turn stays, tied or repeated; an empty table gives an empty result.
    """
    return formatted.mapInArrow(_digest(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
