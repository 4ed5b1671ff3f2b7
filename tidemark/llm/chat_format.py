"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered to one string, encoded once with offsets, and the sorted spans of
the assistant's texts are intersected with the token spans by binary search. Markers are special
tokens, so no token straddles the edge of a text. Control strings inside texts and roles are escaped:
``<``, any number of backslashes and ``|`` get one backslash more, which :func:`unescape` takes away.

Results for unusual input: null text or role counts as empty; an empty assistant text has no tokens
under the mask; turns that share a number go by role, then text; rows with a null conversation id form
one conversation with a null id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BODY, END = "<|im_start|>", "<|im_body|>", "<|im_end|>"
FORMATTED = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the span of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = START + escape(role) + BODY, escape(text), END + "\n"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@cache
def tokenizer(path: str):
    """The byte-level tokenizer at ``path`` with the markers as special tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer, processors

    loaded = Tokenizer.from_file(path)
    loaded.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, BODY, END)])
    loaded.post_processor = processors.ByteLevel(trim_offsets=False)
    return loaded


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for the tokens that lie in one of the sorted spans."""
    out = np.zeros(len(starts), bool)
    if spans:
        first = np.searchsorted(starts, [s for s, _ in spans], "left")
        last = np.searchsorted(ends, [e for _, e in spans], "right")
        for (s, e), a, b in zip(spans, first, last, strict=True):
            if e > s:
                out[a:b] = True
    return out


def format_chats(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation: the rendered string, its tokens with offsets in code points, and the loss mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch["conv_id"], batch["turns"], strict=True):
                formatted, spans = render([(t["role"], t["text"]) for t in turns])
                tokens = encoder.encode(formatted, add_special_tokens=False)
                at = np.array(tokens.offsets, np.int32).reshape(-1, 2)
                rows.append((conv_id, formatted, np.array(tokens.ids, np.int32), at[:, 0], at[:, 1], mask(spans, at[:, 0], at[:, 1])))
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])
            yield out.assign(conv_id=out["conv_id"].astype("Int64"))

    return grouped.mapInPandas(encode, FORMATTED)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, masked: np.ndarray) -> list[str]:
    """The unescaped text of each run of tokens under the mask."""
    s, e, out, at = np.asarray(starts)[masked], np.asarray(ends)[masked], [], 0
    if len(s):
        breaks = np.flatnonzero(s[1:] > e[:-1]) + 1
        for at, to in zip([0, *breaks], [*breaks, len(s)], strict=True):
            out.append(unescape(formatted[s[at] : e[at:to].max()]))
    return out


def digests(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what can be read back from the output of :func:`format_chats`."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                turns = parse(r.formatted)
                loss = "".join(masked_texts(r.formatted, r.token_starts, r.token_ends, np.asarray(r.loss_mask, bool)))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((r.conv_id, len(turns), _sha(said), len(loss), _sha(loss), len(r.formatted), len(r.token_ids)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])
            yield out.assign(conv_id=out["conv_id"].astype("Int64"))

    return chats.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
