"""Static range asymmetric numeral coding of token ids, vectorised over independent blocks.

A section is a run of tokens with one frequency table. It is cut into blocks of 16,384 tokens; a block interleaves 64
coder states, so that one numpy step codes a token of every state of every block. A block holds its token count, the
crc32 of its ids, its checkpoints (the word offset and the 64 states at every 128th step, the first included) and its
words; each stretch between checkpoints can be decoded by itself, and ``decode`` works on all of them at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS, EVERY = 64, 256, 128
BLOCK = LANES * STEPS
PRECISION = 20
SCALE = 1 << PRECISION
LOW = 1 << 31
_HEAD = struct.Struct("<IIHH")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur and their frequencies scaled to add up to SCALE, each 1 at least."""
    symbols, n = np.unique(ids, return_counts=True)
    if len(symbols) > SCALE // 2:
        raise ValueError("too many symbols for the table")
    f = np.maximum(1, np.floor(n * (SCALE / n.sum()))).astype(np.int64)
    over = int(f.sum()) - SCALE
    order = np.argsort(-f, kind="stable")
    while over > 0:  # rare symbols were raised to 1: the frequent ones pay for it in proportion
        part = f[order]
        cut = np.minimum(part - 1, np.maximum(1, (part * over) // max(1, int(part.sum()))))
        cut = np.where(np.cumsum(cut) <= over, cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        f[order] -= cut
        over = int(f.sum()) - SCALE
    f[order[0]] -= over
    return symbols.astype(np.uint32), f.astype(np.uint32)


def encode(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """The blocks of a section."""
    if not len(ids):
        return []
    n_blocks = -(-len(ids) // BLOCK)
    start = np.cumsum(freq, dtype=np.uint64) - freq
    place = np.zeros(int(symbols[-1]) + 1, np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    at = place[ids]
    at = np.concatenate([at, np.full(n_blocks * BLOCK - len(ids), np.argmax(freq), np.uint32)])
    # by step: tokens of a block are dealt to its states in turn
    at = at.reshape(n_blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, -1)
    state = np.full(n_blocks * LANES, LOW, np.uint64)
    words = np.zeros((STEPS, n_blocks * LANES), np.uint32)
    sent = np.zeros((STEPS, n_blocks * LANES), bool)
    saved = {}
    freq64, unit = freq.astype(np.uint64), np.uint64((LOW >> PRECISION) << 32)
    for s in range(STEPS - 1, -1, -1):
        f, c = freq64[at[s]], start[at[s]]
        full = state >= unit * f
        words[s], sent[s] = state, full
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << np.uint64(PRECISION)) + (state - q * f) + c
        if s % EVERY == 0:
            saved[s] = state.reshape(n_blocks, LANES)
    words = words.reshape(STEPS, n_blocks, LANES).transpose(1, 0, 2)
    sent = sent.reshape(STEPS, n_blocks, LANES).transpose(1, 0, 2)
    out = []
    marks = range(0, STEPS, EVERY)
    for b in range(n_blocks):
        own = ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4")
        per_step = sent[b].sum(1)
        offsets = np.array([per_step[:m].sum() for m in marks], "<u4")
        states = np.stack([saved[m][b] for m in marks]).astype("<u8")
        out.append(_HEAD.pack(len(own), zlib.crc32(own.tobytes()), LANES, len(offsets)) + offsets.tobytes() + states.tobytes() + words[b][sent[b]].astype("<u4").tobytes())
    return out


def decode(blocks: list[bytes], symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The ids of a section's blocks, or of any choice of them; a damaged block raises ValueError."""
    if not blocks:
        return np.zeros(0, np.uint32)
    start = (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
    slot_of = np.repeat(np.arange(len(symbols), dtype=np.uint16 if len(symbols) <= 1 << 16 else np.uint32), freq)
    heads, states, streams, at = [], [], [], []
    base = 0
    for block in blocks:
        n, crc, lanes, marks = _HEAD.unpack_from(block)
        if lanes != LANES or marks != STEPS // EVERY:
            raise ValueError("not a block of this format")
        p = _HEAD.size
        offsets = np.frombuffer(block, "<u4", marks, p)
        states.append(np.frombuffer(block, "<u8", marks * lanes, p + 4 * marks).reshape(marks, lanes))
        words = np.frombuffer(block, "<u4", offset=p + 4 * marks + 8 * marks * lanes)
        streams.append(words)
        at.append(base + offsets.astype(np.int64))
        heads.append((n, crc))
        base += len(words)
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    state, at = np.concatenate(states).astype(np.uint64), np.concatenate(at)
    found = np.empty((EVERY, len(at), LANES), np.uint32)
    freq64, mask = freq.astype(np.uint64), np.uint64(SCALE - 1)
    for s in range(EVERY):
        slot = state & mask
        k = slot_of[slot]
        found[s] = k
        state = freq64[k] * (state >> np.uint64(PRECISION)) + slot - start[k]
        low = state < np.uint64(LOW)
        turn = np.cumsum(low, 1)
        where = at[:, None] + turn - 1
        state = np.where(low, (state << np.uint64(32)) | stream[np.where(low, where, 0)], state)
        at = at + turn[:, -1]
    ids = symbols[found.transpose(1, 0, 2).reshape(len(blocks), BLOCK)]
    out = []
    for (n, crc), own in zip(heads, ids, strict=True):
        own = own[:n]
        if zlib.crc32(own.astype("<u4").tobytes()) != crc:
            raise ValueError("the checksum of a block differs")
        out.append(own)
    return np.concatenate(out)
