"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of at most ``budget`` tokens. Prefix
sums of turn tokens choose turn-aligned spans; the system turn is retained in
every window, as much of the preceding history as ``history`` tokens hold is
repeated, and the loss mask covers each assistant text once: repeated turns are
context only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, table

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that some chat template reads as control; none of them survives in a text.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")

_escape_at = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_inner = re.compile("|".join(f"(?={re.escape(c)})" for c in CONTROL))


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control
    string, also of those that overlap; ``unescape`` is its inverse."""
    starts = {m.start() for m in _inner.finditer(text)}
    if not starts and "\\" not in text:
        return text
    return "".join(c + "\\" * (c == "\\" or i in starts) for i, c in enumerate(text))


def unescape(text: str) -> str:
    """Drops each backslash that ``escape`` added."""
    return text if "\\" not in text else re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


def escape_role(role: str) -> str:
    """As ``escape``, with line ends as a backslash and n, since a role ends its line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\\\|\\n|\\", lambda m: {"\\\\": "\\", "\\n": "\n", "\\": ""}[m[0]], role)


_piece = re.compile(r"\w+|[^\w\s]")


@lru_cache(4)
def token_counter(path: str | None) -> Callable[[str], int]:
    """Tokens of a text by a tokenizers .json file, or, without one, the runs of
    word characters and single marks in it."""
    if path is None:
        return lambda text: len(_piece.findall(text))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: len(tok.encode(text, add_special_tokens=False))


class Windows:
    """The windows of one conversation, turn by turn.

    ``sums`` are the prefix sums of the tokens of ``turns``, which begin with what
    may still be repeated; ``first`` is where the open window starts and ``new``
    its first turn that no earlier window had."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.turns, self.sums, self.first, self.new, self.no, self.system, self.begun = [], [0], 0, 0, 0, None, False

    def add(self, turn: tuple[str, str, int, int]) -> tuple | None:
        """Takes (role, formatted, tokens, offset of the text); gives the window
        that is complete if this turn doesn't fit it."""
        done = None
        if not self.begun and turn[0] == "system":
            self.system = turn
        self.begun = True
        if len(self.turns) > self.new and self._size(len(self.turns)) + turn[2] > self.budget:
            done = self.close()
            end = len(self.turns)
            keep = bisect_left(self.sums, self.sums[end] - self.history)
            self.turns, self.sums = self.turns[keep:], [x - self.sums[keep] for x in self.sums[keep:]]
            self.new, self.first = end - keep, 0
            while self.first < self.new and self._size(self.new) + turn[2] > self.budget:
                self.first += 1
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        return done

    def _led(self) -> bool:
        """Whether the system turn has to be put before the span."""
        return self.system is not None and self.no > 0 and not any(t is self.system for t in self.turns[self.first :])

    def _size(self, end: int) -> int:
        return self.sums[end] - self.sums[self.first] + (self.system[2] if self._led() else 0)

    def close(self) -> tuple:
        """(conv_id, window, text, loss spans, number of repeated turns)"""
        lead = [self.system] if self._led() else []
        shown, repeated = lead + self.turns[self.first :], len(lead) + self.new - self.first
        at, loss = 0, []
        for i, (role, body, _, inner) in enumerate(shown):
            if role == "assistant" and i >= repeated:
                loss += [at + inner, at + len(body) - len(CLOSE)]
            at += len(body)
        self.no += 1
        return self.conv, self.no - 1, "".join(t[1] for t in shown), loss, repeated


NAMES = ["conv_id", "window", "text", "loss", "n_repeated"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()]


def _format(budget: int, history: int, tokenizer: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns come sorted by conversation and turn; no conversation is held."""
    count, now, out, held = token_counter(tokenizer), None, [], 0
    for b in batches:
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if now is None or now.conv != conv:
                if now:
                    out.append(now.close())
                now = Windows(conv, budget, history)
            head = f"{OPEN}{escape_role(role)}{MIDDLE}"
            body = f"{head}{escape(text)}{CLOSE}"
            done = now.add((role, body, count(body), len(head)))
            if done:
                out.append(done)
                held += len(done[2])
            if held > 1 << 21 or len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)
                out, held = [], 0
    if now:
        out.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 256, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, window, text, loss, n_repeated) from (conv_id, turn, role, text).

    ``loss`` lists start and end code points of the spans under the loss mask;
    the first ``n_repeated`` turns of a window repeat earlier ones. Turns are
    ordered by (turn, role, text), nulls first, so ties and repeated rows have a
    place each. A null text or role is empty; a null conv_id is a conversation.
    A turn above the budget has a window for itself and is kept whole. The first
    turn of a conversation is its system turn if its role is "system". An empty
    table gives no rows; other columns are ignored. ``tokenizer`` is the path of a
    tokenizers file that every executor can read.
    """
    arrow_batches(turns.sparkSession)
    own = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(partial(_format, budget, history, tokenizer), "conv_id long, window long, text string, loss array<long>, n_repeated long")


_turn = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    return [(unescape_role(r), unescape(t)) for r, t in _turn.findall(text)]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, out, begun = None, [], False
    for b in batches:
        for conv, text, loss, repeated in zip(*(b.column(b.schema.names.index(n)).to_pylist() for n in ("conv_id", "text", "loss", "n_repeated")), strict=True):
            if not begun or now[0] != conv:
                if begun:
                    out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                now, begun = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            for role, said in parse(text)[repeated:]:
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for a, z in zip(loss[::2], loss[1::2], strict=True):
                said = unescape(text[a:z])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
        if len(out) > 5000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
            out = []
    if begun:
        out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, parsed from the formatted texts.
    ``windows`` has a conversation's windows in order in one partition, as
    ``format_chats`` makes them."""
    return windows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(format_chats(turns.unionByName(own), budget=256, history=64))
