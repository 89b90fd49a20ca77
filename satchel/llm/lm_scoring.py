"""Scores of whole texts by a causal self-attention model over subword ids.

A text is its words and an end; a word is the subword ids that a public tokenizer gives
for it on its own. The model reads ids x[0..i] and gives the next one by its class,

    p(y | x) = p(class(y) | x) * p(y | class(y)),
    p(class | x) = softmax((E Wr)[x_i] + attention, ...),

where the attention of position i is over the positions up to i in its window, with a
learned bias for each distance. One attention layer's queries, keys, values and residuals
depend on the id alone, so they are tables; what is left per position is the batched
masked attention itself. Windows overlap by half: each id is scored once, in the second
half of its window. Which ids form a class comes from their contexts; p(y | class) from
the ids' counts in all training texts.

Ids of pieces that begin a word, and the end, open a token; no other id does. With B(x)
the probability that the next id opens one, a word's probability under the network is

    p(first id | x) / B(x) * product of the others * B(x with the word),

that is, its ids follow and then the word is over; the end's is p(end | x) / B(x). Words and
the end together have probability 1. A word that its ids do not spell (it holds the mark of
a word's beginning) shares SPELLED of it and is spelled by bytes, all alike, with a stop.

A word's probability is a mixture of the network's and of its share of all training words
(words that did not occur have the first part alone), so both the counts of the whole
corpus and the context count, and what follows has probability 1 at most in any context.

Data flow. Texts are dealt to blocks of about BLOCK_CHARS by a hash. Each block is packed
once: its distinct words with their ids, and its texts as indices into them; all later
passes read these packs. A word belongs to an owner by its hash. Each pack sends its words'
hashes and counts in one list to each owner, which sums them and answers each list with the
totals, in its order; a pack's words are numbered in the order of their owners. So no task
holds more than a block of texts and the words in it, or an owner's lists (about OWNED
blocks' words); the vocabulary is never in one place, and a very common word is one
number in each list. Words are told apart by 64-bit hashes. Lists are kept compressed.

The network is fitted on every training text but one in TUNE: each pack counts its ids'
contexts and deals its windows to ROUNDS rounds, each window to one at least; in each round
it takes steps over that round's windows; after a round the packs' moves are averaged,
weighted by how often each id was seen. Its size is set by the tokenizer's vocabulary. The
mixture's weight comes from the texts left out, chosen by a hash of the text and packed on
their own.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import materialise

#: Half a window; width of the model; classes.
HALF, WIDTH, CLASSES = 8, 16, 64
#: Rounds after which the blocks' weights are merged, a block's steps in all rounds, and windows of a step at least.
ROUNDS, STEPS, BATCH = 3, 180, 256
#: Windows of a step whose gradients are computed at once, so they stay in the cache.
CHUNK = 256
#: One text in so many is kept from the network, for the mixture's weight.
TUNE = 50
#: Frequent ids whose neighbourhood tells contexts apart, parts in which contexts and weights are summed, and blocks that are merged at once at most.
FREQUENT, PARTS, MERGED = 256, 16, 64
BLOCK_CHARS = 8_000_000
#: Blocks whose words' number an owner of words has at most, about.
OWNED = 4
#: The probability of words that their ids do not spell.
SPELLED = 1e-4
#: The base counts: what is added to each count.
ADDED = 0.1


class Subwords:
    """Ids of words. Ids: pad, start, end, then the tokenizer's."""

    PAD, START, END, FIRST = 0, 1, 2, 3
    #: What a piece that begins a word begins with.
    MARK = "\u2581".encode()
    #: Words whose ids are kept.
    KEPT = 2**19

    def __init__(self, processor):
        self._known, self._kept = {}, tuple(np.zeros(0, np.int32) for _ in range(3))
        self._encode, self.size = processor.encode, processor.get_piece_size() + self.FIRST
        names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
        self._bytes = [bytes([int(n[3:-1], 16)]) if processor.is_byte(i) else n.encode() for i, n in enumerate(names)]
        #: Which ids open a token.
        self.opening = np.array([i == self.END for i in range(self.FIRST)] + [b.startswith(self.MARK) for b in self._bytes])
        self._size = np.array([len(b) for b in self._bytes])
        self._at, self._all = np.cumsum(self._size) - self._size, np.frombuffer(b"".join(self._bytes), np.uint8)

    def _unspelled(self, words: list[bytes], length: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The bytes of each word that its ids (the tokenizer's) do not spell, 0 for others."""
        size, many = np.fromiter(map(len, words), np.int32, len(words)), self._size[flat]
        ends = np.append(0, np.cumsum(many))
        last = np.cumsum(length)
        same = ends[last] - ends[last - length] == size + len(self.MARK)
        ids, all_words = np.repeat(same, length), self.MARK.join([b"", *(w for w, x in zip(words, same, strict=True) if x)])
        spelt = self._all[_spread(self._at[flat[ids]], many[ids])]
        agree = np.append(0, np.cumsum(spelt == np.frombuffer(all_words, np.uint8)))
        end = np.cumsum(size[same] + len(self.MARK))
        same[same] = agree[end] - agree[end - size[same] - len(self.MARK)] == size[same] + len(self.MARK)
        if all_words.count(self.MARK) > len(end):
            same &= np.fromiter((self.MARK not in w for w in words), bool, len(words))
        return np.where(same, 0, size)

    def pieces(self, words: list[bytes]) -> Pieces:
        """The words' ids; those of the first KEPT words that a worker meets are kept for its later blocks."""
        at = np.fromiter(map(self._known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        some = [words[i] for i in new.tolist()]
        at[new] = len(self._known) + np.arange(len(new))
        both = Pieces(*map(np.concatenate, zip(self._kept, self._encoded(some), strict=True)))
        if room := self.KEPT - len(self._known):
            self._known.update(zip(some[:room], range(len(self._known), self.KEPT), strict=False))
            n = len(self._known)
            self._kept = both.length[:n].astype(np.int32), both.flat[: both.length[:n].sum()], both.spelled[:n]
        return Pieces(both.length[at], both.flat[_spread(both.begin[at], both.length[at])], both.spelled[at])

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many ids each word has, the ids, the bytes of each word that its ids do not spell)."""
        lengths, flat, spelled = ([np.zeros(0, np.int32)] for _ in range(3))
        for lo in range(0, len(words), 20_000):
            some = words[lo : lo + 20_000]
            got = self._encode(some, num_threads=1)
            lengths.append(np.fromiter(map(len, got), np.int32, len(got)))
            ids = np.fromiter(chain.from_iterable(got), np.int32, int(lengths[-1].sum()))
            flat.append(ids + np.int32(self.FIRST))
            spelled.append(self._unspelled(some, lengths[-1], ids).astype(np.int32))
        return tuple(map(np.concatenate, (lengths, flat, spelled)))


@lru_cache(1)
def _subwords(path: str | None) -> Subwords:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Subwords(sentencepiece.SentencePieceProcessor(model_file=path))


def _spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The indices begin[0], begin[0] + 1, ... (many[0] of them), begin[1], ..."""
    last = np.cumsum(many)
    n = int(last[-1]) if len(last) else 0
    kind = np.int32 if max(n, int(begin.max(initial=0)) + int(many.max(initial=0))) < 2**31 else np.int64
    out = np.repeat((begin - last + many).astype(kind), many)
    out += np.arange(n, dtype=kind)
    return out


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 as bytes, compressed: the lowest byte of each, then the next one, as far as any number needs."""
    many = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = b"".join((x >> 8 * k).astype(np.uint8).tobytes() for k in range(many))
    return len(x).to_bytes(8, "little") + bytes([many]) + (pa.compress(planes, "zstd", asbytes=True) if many else b"")


def _unsqueezed(data: bytes, kind: type = np.int32) -> np.ndarray:
    n, many = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros(n, kind)
    if many:
        for k, plane in enumerate(np.frombuffer(pa.decompress(data[9:], n * many, "zstd"), np.uint8).reshape(many, n)):
            out |= plane.astype(kind) << 8 * k
    return out


class Block:
    """The words of some texts: ``words`` (distinct), ``w`` (the texts' indices into them, one text after another) and the texts' ``sizes``."""

    def __init__(self, texts: list[str]):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        flat, ends = lists.flatten(), np.asarray(lists.offsets)
        some = np.asarray(pc.binary_length(flat)) > 0  # white space at a text's ends leaves empty words
        before = np.append(0, np.cumsum(some))
        found = flat.filter(pa.array(some)).dictionary_encode()
        self.w, self.sizes = np.asarray(found.indices).astype(np.int32), np.diff(before[ends]).astype(np.int32)
        self.words = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    def order(self, key: np.ndarray) -> np.ndarray:
        """Numbers the words anew by ``key``; the former numbers in the new order."""
        order = np.argsort(key, kind="stable")
        new = np.empty(len(order), np.int32)
        new[order] = np.arange(len(order), dtype=np.int32)
        self.w, self.words = new[self.w], [self.words[i] for i in order.tolist()]
        return order


class Pieces:
    """The ids of a block's words, one after another; ``spelled`` has the bytes of each word that its ids do not spell, 0 for others."""

    def __init__(self, length: np.ndarray, flat: np.ndarray, spelled: np.ndarray | None = None):
        self.length, self.flat = length.astype(np.int64), flat
        self.spelled = np.zeros(len(length), np.int32) if spelled is None else spelled
        self.begin = np.cumsum(self.length) - self.length

    @cached_property
    def ended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, flat) with the end as a last word, so that its index is -1."""
        return np.append(self.begin, len(self.flat)), np.append(self.length, 1), np.append(self.flat, np.int32(Subwords.END))


def _blocks(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(texts' first blocks, number of blocks, own, place): texts in blocks of HALF, each after a block of pads; id own[i] is in place[i]."""
    many = -(-sizes // HALF) + 1
    first = np.cumsum(many) - many
    return first, int(many.sum()), _spread(starts, sizes), _spread((first + 1) * HALF, sizes)


def _windows(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, own): indices into x of each window's 2 * HALF ids, -1 where there is none, and which of the second half count.

    Texts begin at ``starts`` in x and have ``sizes`` ids. A window is two neighbouring blocks.
    """
    first, many, own, place = _blocks(starts, sizes)
    at = np.full(many * HALF, -1)
    at[place] = own
    at = at.reshape(-1, HALF)
    at = np.delete(np.concatenate([at[:-1], at[1:]], 1), first[1:] - 1, axis=0)
    return at, at[:, HALF:] >= 0


def _full_windows(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows for training: where each begins and how many ids it has, 2 * HALF at most, one window after another."""
    many = -(-sizes // (2 * HALF))
    begin = np.repeat(starts - (np.cumsum(many) - many) * 2 * HALF, many) + np.arange(many.sum()) * 2 * HALF
    return begin, np.minimum(np.repeat(starts + sizes, many) - begin, 2 * HALF)


def _exp(x: np.ndarray) -> np.ndarray:
    """e to the power of x, at most 60, in place."""
    if x.size and x.max() > 60:
        np.minimum(x, np.float32(60), out=x)
    return np.exp(x, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which stays; by a product, which is faster where it is short."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


class AttentionModel:
    """Tables and weights; ``log_probs`` scores next ids. ``opens`` is the part of each class that opens a token, all of it unless given."""

    def __init__(self, e, wq, wk, wv, wr, distance, wc, bias, cls, within, mix, opens=None):
        self.e, self.wq, self.wk, self.wv, self.wr, self.distance, self.wc, self.bias = e, wq, wk, wv, wr, distance, wc, bias
        self.cls, self.within, self.mix = cls, within, mix
        self.opens = np.ones(CLASSES, "f4") if opens is None else opens
        self.tables()

    def tables(self) -> None:
        scale = np.float32(WIDTH**-0.5)
        self.table = self.e @ np.concatenate([self.wq * scale, self.wk, self.wv, self.wr], 1)  # one look-up
        self.of_target = self.within + self.bias[self.cls]
        self.of_class = np.exp(self.bias)[:, None] * np.stack([np.ones(CLASSES, "f4"), self.opens.astype("f4")], 1)
        i, j = np.arange(2 * HALF)[:, None], np.arange(2 * HALF)
        self.mask = np.where(j <= i, self.distance[np.clip(i - j, 0, 2 * HALF - 1)], np.float32(-1e9)).astype("f4")

    def attend(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The attention's output with the residual for ids in blocks of HALF, but the first block; the block before those in ``begins`` is no context."""
        g = self.table.take(ids, axis=0)
        row, item = g.strides
        q, r = (g[HALF:].reshape(-1, HALF, 4 * WIDTH)[:, :, j : j + WIDTH] for j in (0, 3 * WIDTH))
        k, v = (as_strided(g[:, j:], (len(q), 2 * HALF, WIDTH), (HALF * row, row, item), writeable=False) for j in (WIDTH, 2 * WIDTH))  # windows overlap
        a = q @ k.transpose(0, 2, 1)
        a += self.mask[HALF:]
        _exp(a)
        a[begins, :, :HALF] = 0
        h = a @ v
        h /= _sums(a) + np.float32(1e-20)
        h += r
        return h.reshape(-1, WIDTH)

    def log_probs(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
        """log p(y[i] | x up to i in its window), each once."""
        return self.log_probs_and_openings(x, y, starts, sizes, batch)[0]

    def log_probs_and_openings(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray, sizes: np.ndarray, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(``log_probs``, the logarithm of the probability that the next id opens a token)."""
        first, many, own, place = _blocks(starts, sizes)
        ids, target = (np.zeros(many * HALF, np.int32) for _ in range(2))
        ids[place], target[place] = x[own], y[own]
        cls, found, opening = self.cls.astype(np.int32)[target], np.empty(len(ids), "f4"), np.empty(len(ids), "f4")
        for lo in range(HALF, len(ids), batch * HALF):
            part, block = slice(lo, min(lo + batch * HALF, len(ids))), lo // HALF
            begins = first[np.searchsorted(first, block - 1) : np.searchsorted(first, block + batch - 1)] + 1 - block
            z = self.attend(ids[lo - HALF : part.stop], begins) @ self.wc
            wanted = np.minimum(z.ravel().take(np.arange(0, z.size, CLASSES) + cls[part]), np.float32(60))
            total, opens = np.log(np.maximum(_exp(z) @ self.of_class, np.float32(1e-30))).T
            np.subtract(wanted, total, out=found[part])
            np.subtract(opens, total, out=opening[part])
        found += self.of_target[target]
        out = np.empty((2, len(y)), "f4")
        out[0, own], out[1, own] = found[place], opening[place]
        return out[0], out[1]

    def rows(self) -> np.ndarray:
        """All weights in rows of WIDTH, first those of the ids."""
        return np.concatenate([getattr(self, n).reshape(-1, WIDTH) for n in ("e", "wq", "wk", "wv", "wr", "distance", "wc", "bias")])

    def set_rows(self, rows: np.ndarray) -> None:
        at = 0
        for n in ("e", "wq", "wk", "wv", "wr", "distance", "wc", "bias"):
            old = getattr(self, n)
            setattr(self, n, rows[at : at + old.size // WIDTH].reshape(old.shape).astype("f4"))
            at += old.size // WIDTH
        self.tables()

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *(getattr(self, n) for n in ("e", "wq", "wk", "wv", "wr", "distance", "wc", "bias", "cls", "within")), np.float64(self.mix), self.opens)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> AttentionModel:
        x = np.load(io.BytesIO(data))
        parts = [x[f"arr_{i}"] for i in range(12)]
        return cls(*parts[:10], float(parts[10]), parts[11])


def _frequent(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")[:FREQUENT]


def _pairs(x: np.ndarray, size: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers) of pairs inside texts: key id * 2 * FREQUENT + place of the frequent id before it, or FREQUENT + place of that after it."""
    kind = np.int32 if size * 2 * FREQUENT < 2**31 else np.int64
    column, keys = np.full(size, -1, kind), []
    column[frequent] = np.arange(len(frequent))
    of, inner = column[x], x[1:] != Subwords.START
    for a, b, at in ((x[1:], of[:-1], 0), (x[:-1], of[1:], FREQUENT)):
        seen = (b >= 0) & inner
        keys.append(a[seen].astype(kind) * kind(2 * FREQUENT) + (b[seen] + kind(at)))
    keys, n = np.unique(np.concatenate(keys), return_counts=True)
    return keys.astype(np.int64), n


def _contexts(m: np.ndarray) -> np.ndarray:
    """For each id WIDTH numbers that tell its neighbours apart: a truncated SVD of damped counts."""
    m = np.sqrt(m, dtype="f4")
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1.0
    _, vec = np.linalg.eigh(m.T @ m)
    return m @ vec[:, ::-1][:, :WIDTH]


def _classes(features: np.ndarray, counts: np.ndarray, begins: np.ndarray, rng) -> np.ndarray:
    """A class for each id: the end, frequent ids alone, the others by k-means among ids that begin words and among the rest."""
    cls = np.zeros(len(counts), np.int64)
    alone = np.argsort(-counts[Subwords.FIRST :], kind="stable")[: CLASSES // 3] + Subwords.FIRST
    cls[alone] = 1 + np.arange(len(alone))
    free, used = np.ones(len(counts), bool), 1 + len(alone)
    free[: Subwords.FIRST] = free[alone] = False
    for kind, many in ((begins, (CLASSES - used) // 2), (~begins, CLASSES - used - (CLASSES - used) // 2)):
        at = np.flatnonzero(free & kind)
        if not len(at):
            continue
        f, w = features[at], counts[at] + 0.01
        centres = f[rng.choice(len(at), many, p=w / w.sum())]
        for _ in range(12):
            near = np.argmin((centres * centres).sum(1) - 2 * f @ centres.T, axis=1)
            weight = np.bincount(near, weights=w, minlength=many)
            centres = np.stack([np.bincount(near, weights=w * f[:, d], minlength=many) for d in range(f.shape[1])], 1) / np.maximum(weight, 1e-9)[:, None]
        cls[at] = used + near
        used += many
    return cls


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different ids, each id's place among them)."""
    seen = np.zeros(int(ids.max(initial=0)) + 1, bool)
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[ids]


def initial(m: np.ndarray, counts: np.ndarray, begins: np.ndarray, seed: int = 5, opening: np.ndarray | None = None) -> AttentionModel:
    """The model before its first step, from contexts' and ids' numbers in all texts; ``opening`` marks the ids that open a token (all unless given)."""
    rng, size = np.random.default_rng(seed), len(counts)
    counts = counts.astype(float)
    features = _contexts(m)
    cls = _classes(features, counts, begins, rng)
    in_class = np.bincount(cls, weights=counts + ADDED, minlength=CLASSES)
    within = np.log((counts + ADDED) / in_class[cls]).astype("f4")
    within[Subwords.END] = 0
    within[[Subwords.PAD, Subwords.START]] = -60
    normal = lambda *s: (rng.normal(size=s) * WIDTH**-0.5).astype("f4")
    scale = 1 / (features[counts > 0].std() + 1e-9) if counts.any() else 1.0
    e = (features * scale + 0.1 * rng.normal(size=(size, WIDTH))).astype("f4")
    opens = None if opening is None else np.bincount(cls, weights=np.exp(within) * opening, minlength=CLASSES).astype("f4")
    first = np.log(np.bincount(cls, weights=counts, minlength=CLASSES) + 1.0)
    return AttentionModel(e, normal(WIDTH, WIDTH), normal(WIDTH, WIDTH), normal(WIDTH, WIDTH), normal(WIDTH, WIDTH), np.zeros(2 * HALF, "f4"), 0.1 * normal(WIDTH, CLASSES), (first - first.max()).astype("f4"), cls, within, 0.5, opens)


def shares(x: np.ndarray, parts: int, seed: int = 5) -> list[np.ndarray]:
    """The windows of texts' ids in ``parts`` shares, in random order; a window is its 2 * HALF ids, each text's first one a start, and the next id; pads fill it up."""
    starts = np.flatnonzero(x == Subwords.START)
    begin, many = _full_windows(starts, np.diff(np.append(starts, len(x))))
    order = np.random.default_rng(seed).permutation(len(begin))
    x = np.append(x, np.full(2 * HALF + 1, Subwords.START, x.dtype)).astype(np.int32)
    out = []
    for part in range(parts):
        some = order[part::parts] if len(order) >= parts else order
        at = begin[some][:, None] + np.arange(2 * HALF + 1)
        own = np.where(np.arange(2 * HALF + 1) <= many[some][:, None], x[at], Subwords.PAD)
        last = own[:, 1:]
        last[last == Subwords.START] = Subwords.END
        out.append(own)
    return out


def descend(m: AttentionModel, x: np.ndarray, steps: int, part: int = 0, parts: int = 1, seed: int = 5) -> tuple[np.ndarray, int]:
    """``take_steps`` over share ``part`` of ``parts`` of the windows of texts' ids, each after a start."""
    return take_steps(m, shares(x, parts, seed)[part], steps, part, parts)


def take_steps(m: AttentionModel, windows: np.ndarray, steps: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, int]:
    """Takes steps over a share of windows, each at least once; (how often each id was in them, next ids in them)."""
    size, span, shared = len(m.e), 2 * HALF, ("wq", "wk", "wv", "wr", "distance", "wc", "bias")
    inside, nexts = windows[:, 1:] != Subwords.PAD, windows[:, 1:]
    windows = np.where(inside, windows[:, :-1], Subwords.PAD)
    cls = m.cls[nexts]
    seen = np.bincount(windows.ravel(), minlength=size), int(inside.sum())
    batch = max(BATCH, -(-len(windows) // steps))
    chunk = -(-batch // -(-batch // CHUNK))  # chunks of a step are alike
    turns = np.resize(np.arange(len(windows)), steps * batch)
    mean = {n: np.zeros_like(getattr(m, n)) for n in ("e", *shared)}
    square = {n: np.zeros_like(getattr(m, n)) for n in ("e", *shared)}
    scale, lag = np.float32(WIDTH**-0.5), np.clip(np.arange(span)[:, None] - np.arange(span), 0, span - 1).ravel()

    def add_gradients(sums: list[np.ndarray], table: np.ndarray, place: np.ndarray, own: np.ndarray, to: np.ndarray, weight: np.float32, bias: np.ndarray, pairs: np.ndarray, outs: np.ndarray, odds: np.ndarray) -> None:
        """Adds those of some windows of a step to ``sums``: of table's e, pairs, outs, the attention's bias and the classes' one.

        The matrices meet in products only, so gradients are taken of those: logits of the
        attention are e pairs e', those of the classes (attention e, e) outs, with odds as
        factors. Pads come last in a window, so no id attends to them.
        """
        g = table.take(place, axis=0)
        q, k = g[:, :, :WIDTH], g[:, :, WIDTH:]
        a = q @ k.transpose(0, 2, 1)
        a += bias
        _exp(a)
        a *= 1 / (_sums(a) + np.float32(1e-20))
        h = np.empty_like(g)
        np.matmul(a, k, out=h[:, :, :WIDTH])
        h[:, :, WIDTH:] = k
        h = h.reshape(-1, 2 * WIDTH)
        z = _exp(h @ outs)
        total = z @ odds + np.float32(1e-20)
        z.ravel()[np.arange(0, z.size, CLASSES) + to.ravel()] -= total / odds[to.ravel()]
        z *= (own.ravel() * weight / total)[:, None]
        back = (z @ (outs * odds).T).reshape(g.shape)
        da = back[:, :, :WIDTH] @ k.transpose(0, 2, 1)
        da -= np.einsum("nij,nij->ni", da, a)[:, :, None]
        da *= a
        dq = (da @ k).reshape(-1, WIDTH)
        de = da.transpose(0, 2, 1) @ q
        de += a.transpose(0, 2, 1) @ back[:, :, :WIDTH]
        de += back[:, :, WIDTH:]
        de = de.reshape(-1, WIDTH)
        de += dq @ pairs.T
        two = np.arange(WIDTH // 2)  # numbers are added in twos
        np.add.at(sums[0].view(np.complex64).ravel(), (place.reshape(-1, 1) * len(two) + two).ravel(), de.view(np.complex64).ravel())
        sums[1] += g.reshape(-1, 2 * WIDTH)[:, WIDTH:].T @ dq
        sums[2] += h.T @ z
        sums[3] += da.sum(0)
        sums[4] += np.ones(len(z), "f4") @ z

    for step in range(1, steps + 1):
        now = turns[(step - 1) * batch : step * batch]
        ids, place = _numbered(windows[now])
        own, to, weight = inside[now], cls[now], np.float32(1 / max(int(inside[now].sum()), 1))
        e, query, bias = m.e[ids], m.wq * scale, np.where(np.tri(span, dtype=bool), m.distance[lag].reshape(span, span), np.float32(-1e9))
        pairs, outs, odds = query @ m.wk.T, np.concatenate([m.wv @ m.wc, m.wr @ m.wc]), np.exp(m.bias)
        table = np.concatenate([e @ pairs, e], 1)
        sums = [np.zeros_like(x) for x in (e, pairs, outs, bias, odds)]
        for lo in range(0, batch, chunk):
            some = slice(lo, lo + chunk)
            add_gradients(sums, table, place[some], own[some], to[some], weight, bias, pairs, outs, odds)
        of_e, of_pairs, (of_v, of_r) = sums[0], sums[1], (sums[2] * odds).reshape(2, WIDTH, CLASSES)
        g = {"wq": of_pairs @ m.wk * scale, "wk": of_pairs.T @ query, "wv": of_v @ m.wc.T, "wr": of_r @ m.wc.T, "wc": m.wv.T @ of_v + m.wr.T @ of_r, "bias": sums[4] * odds}
        g["distance"] = np.bincount(lag, weights=sums[3].ravel(), minlength=span).astype("f4")
        rate = 0.02 * min(1, 2 * (1 - (part + step / (steps + 1)) / parts))
        for n, some, grad in (("e", ids, of_e), *((n, slice(None), g[n]) for n in shared)):  # rows of ids that are not in the batch stay
            mean[n][some] = first = mean[n][some] + np.float32(0.1) * (grad - mean[n][some])
            square[n][some] = second = square[n][some] + np.float32(0.01) * (grad * grad - square[n][some])
            move = first / np.float32(1 - 0.9**step) / (np.sqrt(second / np.float32(1 - 0.99**step)) + np.float32(1e-8))
            getattr(m, n)[some] -= np.float32(rate) * move
    m.tables()
    return seen


def train(ids: list[np.ndarray], counts: np.ndarray, begins: np.ndarray, steps: int = STEPS, seed: int = 5) -> AttentionModel:
    """Fit in one place on texts' ids (without start and end); counts: of each id in all training texts."""
    x = np.concatenate([np.r_[Subwords.START, i] for i in ids] or [np.array([Subwords.START])]).astype(np.int64)
    m = np.zeros((len(counts), 2 * FREQUENT), "f4")
    keys, n = _pairs(x, len(counts), _frequent(counts))
    m.ravel()[keys] = n
    model = initial(m, counts, begins, seed)
    descend(model, x, steps, seed=seed)
    return model


class Pack:
    """Some texts of a block: the words' indices ``w``, one text after another, the texts' ``sizes`` in words, and the words' ids."""

    def __init__(self, w: np.ndarray, sizes: np.ndarray, pieces: Pieces):
        self.w, self.sizes, self.pieces = w, sizes, pieces

    COLUMNS = ("w", "sizes", "lengths", "flat", "spelled")
    SCHEMA = "w binary, sizes binary, lengths binary, flat binary, spelled binary"

    @classmethod
    def of(cls, texts: list[np.ndarray], pieces: Pieces) -> Pack:
        return cls(np.concatenate([np.zeros(0, np.int32), *texts]), np.array([len(t) for t in texts], np.int32), pieces)

    def row(self) -> list[bytes]:
        return [_squeezed(x) for x in (self.w, self.sizes, self.pieces.length, self.pieces.flat, self.pieces.spelled)]

    @classmethod
    def read(cls, *columns: bytes) -> Pack:
        w, sizes, *pieces = map(_unsqueezed, columns)
        return cls(w, sizes, Pieces(*pieces))

    def stream(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts a to b: (word indices with -1 for each end, ids with END for each end, how many ids each word has)."""
        sizes = self.sizes[a:b].astype(np.int64)
        lo = int(self.sizes[:a].sum())
        w = np.full(sizes.sum() + len(sizes), -1, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(w), bool)
        inner[ends] = False
        w[inner] = self.w[lo : lo + int(sizes.sum())]
        begin, length, flat = self.pieces.ended
        many = length[w]
        return w, flat[_spread(begin[w], many)], many

    def training(self, learn: np.ndarray) -> np.ndarray:
        """The ids of the texts marked in ``learn``, each text after a start."""
        sizes = self.sizes[learn].astype(np.int64)
        w = np.full(sizes.sum() + len(sizes), -1, np.int64)
        inner = np.ones(len(w), bool)
        inner[np.cumsum(sizes + 1) - sizes - 1] = False
        w[inner] = self.w[np.repeat(learn, self.sizes)]
        begin, length, flat = self.pieces.ended
        x = flat[_spread(begin[w], length[w])]
        x[x == Subwords.END] = Subwords.START
        return x


def _text_log_probs(model: AttentionModel, pack: Pack, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities of the words and ends of the texts a to b, one after another; the words' indices, -1 for an end)."""
    w, y, many = pack.stream(a, b)
    last = np.cumsum(many)
    x = np.empty_like(y)
    x[1:] = y[:-1]
    ends = last[w < 0]
    starts = np.r_[0, ends[:-1]]
    x[starts] = Subwords.START
    each, opening = model.log_probs_and_openings(x, y, starts, ends - starts)
    sums = np.concatenate([[0.0], np.cumsum(each.astype(float))])
    over = np.append(opening.astype(float), 0.0)  # a word is over where the next id opens a token
    ids = sums[last] - sums[last - many] - over[last - many] + np.where(w < 0, 0.0, over[last])
    size = np.append(pack.pieces.spelled, 0)[w]  # of the end 0
    return np.where(size > 0, np.log(SPELLED) - (size + 1) * np.log(257), np.log1p(-SPELLED) + ids), w


def score_texts(docs: DataFrame, model_path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Rows whose crc32(doc_id as text) mod 10 is 0 are held out; the model and all counts
    come from the others (a null doc_id is one of those). Null texts count as empty and
    are one token, the end. Repeated rows count each. Without training texts every count
    is 0. Of an empty table the result is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.length(text)), F.sum((~held_out).cast("long"))).head()
    chars, train_texts = size[0] or 0, size[1] or 0
    blocks = max(8, -(-chars // block_chars))
    order = F.xxhash64("doc_id", text)
    tune = ~held_out & (F.pmod(F.xxhash64(F.lit("tune"), text), F.lit(TUNE)) == 0)
    rows = docs.select(F.pmod(order, F.lit(blocks)).cast("int").alias("block"), order.alias("order"), "doc_id", held_out.alias("held_out"), tune.alias("tune"), text.alias("text"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    owners = int(max(8, -(-blocks // OWNED)))
    packed = f"block int, part int, kind int, h long, owner int, n long, hashes binary, counts binary, doc_ids array<{kind}>, learn binary, {Pack.SCHEMA}"
    id_list = pa.list_(_arrow_type(docs.schema["doc_id"].dataType))

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of WORDS and TUNED_WORDS: hashes of a pack's words that go to one owner, and their numbers in its training texts; of IDS and BEGINS: ids (h) and their numbers in the pack's training texts, all and those that begin words; of SCORED and TUNED: the packs."""
        subwords = _subwords(model_path)
        part, block, held = 0, None, []

        def out(kind: int, many: int, **given) -> pa.RecordBatch:
            given = {c: pa.array(np.full(many, x, np.int32)) for c, x in (("block", block), ("part", part), ("kind", kind))} | given
            types = {"h": pa.int64(), "owner": pa.int32(), "n": pa.int64(), "hashes": pa.binary(), "counts": pa.binary(), "doc_ids": id_list, "learn": pa.binary()} | {c: pa.binary() for c in Pack.COLUMNS}
            names = ["block", "part", "kind", *types]
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(many, types[c]) for c in names], names)

        def flush(kind: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal part
            part += 1
            b = Block([r[3] for r in rows])
            learn = np.array([not r[1] for r in rows])
            h = b.hashes()
            h = h[b.order(h % np.uint64(owners))]
            pieces = subwords.pieces(b.words)
            pack = Pack(b.w, b.sizes, pieces)
            n = np.bincount(pack.w[np.repeat(learn, pack.sizes)], minlength=len(b.words))
            cuts = np.searchsorted(h % np.uint64(owners), np.arange(owners + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            sent = [[f(x[cuts[o] : cuts[o + 1]]) for o in some] for f, x in ((np.ndarray.tobytes, h), (_squeezed, n))]
            yield out(WORDS if kind == SCORED else TUNED_WORDS, len(some), owner=pa.array(some.astype(np.int32)), hashes=pa.array(sent[0], pa.binary()), counts=pa.array(sent[1], pa.binary()))
            total = np.bincount(pieces.flat, weights=np.repeat(n, pieces.length), minlength=subwords.size)
            some = pieces.length > 0
            begin = np.bincount(pieces.flat[pieces.begin[some]], weights=n[some], minlength=subwords.size)
            for k, t in ((IDS, total), (BEGINS, begin)):
                at = np.flatnonzero(t)
                yield out(k, len(at), h=pa.array(at), n=pa.array(t[at].astype(np.int64)))
            columns = {c: pa.array([x], pa.binary()) for c, x in zip(Pack.COLUMNS, pack.row(), strict=True)}
            yield out(kind, 1, doc_ids=pa.array([[r[0] for r in rows]], id_list), learn=pa.array([learn.tobytes()], pa.binary()), **columns)

        def flush_all() -> Iterator[pa.RecordBatch]:
            for kind, wanted in ((SCORED, False), (TUNED, True)):
                if rows := [r for r in held if r[2] == wanted]:
                    yield from flush(kind, rows)

        waiting = 0
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for b, i, held_out_, tuned, t in zip(batch.column(0).to_pylist(), ids, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if held and (b != block or waiting > 2 * block_chars):
                    yield from flush_all()
                    held, waiting = [], 0
                block = b
                held.append((i, held_out_, tuned, t.as_py()))
                waiting += len(held[-1][3])
        if held:
            yield from flush_all()

    sorted_rows = rows.repartition(int(blocks), "block").sortWithinPartitions("block", "order").select("block", "doc_id", "held_out", "tune", "text")
    counted = materialise(sorted_rows.mapInArrow(pack_blocks, packed), "packs")

    def total(f: pd.DataFrame) -> pd.DataFrame:
        """An owner's answers: the numbers of a pack's words in all training texts; once the sum of these and how many are not 0."""
        sent = [len(x) // 8 for x in f.hashes]
        _, place = np.unique(np.frombuffer(b"".join(f.hashes), np.uint64), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([_unsqueezed(x, np.int64) for x in f.counts])).astype(np.int64)
        found = np.split(sums[place], np.cumsum(sent)[:-1])
        out = pd.DataFrame({"kind": f.kind, "of_block": f.block, "of_part": f.part, "owner": f.owner, "totals": [_squeezed(x) for x in found]})
        return out.assign(tokens=[int(sums.sum())] + [0] * (len(f) - 1), known=[int((sums > 0).sum())] + [0] * (len(f) - 1))

    sent = counted.where(F.col("kind").isin(WORDS, TUNED_WORDS)).select("kind", "block", "part", "owner", "hashes", "counts")
    answers = sent.groupBy("owner").applyInPandas(total, "kind int, of_block int, of_part int, owner int, totals binary, tokens long, known long")
    totals = materialise(answers, "word-totals")
    seen = totals.agg(F.sum("tokens"), F.sum("known")).head()
    n, v = (seen[0] or 0) + train_texts, (seen[1] or 0) + (train_texts > 0)
    ids = counted.where(F.col("kind").isin(IDS, BEGINS)).groupBy("kind", "h").agg(F.sum("n").alias("total")).toPandas()  # no more rows than twice the tokenizer's ids
    packs = counted.where(F.col("kind").isin(SCORED, TUNED)).select("block", "part", "kind", "doc_ids", "learn", *Pack.COLUMNS)
    model = _fit(packs.where(F.col("kind") == SCORED), ids, train_texts, model_path)
    unit = np.log10(n + ADDED * (v + 1)) if n else 0.0
    totals = totals.select("kind", "of_block", "of_part", "owner", "totals")

    def read(row, words: pd.DataFrame) -> tuple[Pack, np.ndarray]:
        """(texts, numbers of the words and the end)."""
        pack = Pack.read(*(getattr(row, c) for c in Pack.COLUMNS))
        answers = words.sort_values("owner").totals  # the words are numbered by their owners
        return pack, np.concatenate([*(_unsqueezed(x, np.int64) for x in answers), [train_texts]])  # index -1 is the end

    def batches_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes + 1) // 20_000, prepend=-1))
        return zip(cuts, [*cuts[1:], len(sizes)], strict=True)

    def weigh(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        """(bin, n): words by the logarithm of the network's probability over their share, each word's own occurrence left out of its count."""
        found = np.zeros(2 * BINS + 1, np.int64)
        net = _model(shared)
        for row in texts.itertuples():
            pack, c = read(row, words)
            for a, b in batches_of(pack.sizes):
                each, w = _text_log_probs(net, pack, a, b)
                less = np.maximum(c[w] - 1, 0)
                ratio = np.where(less > 0, each - np.log((less + ADDED) / (n + ADDED * (v + 1))), np.inf)
                found += np.bincount(np.clip(np.rint(ratio * PER_UNIT), -BINS, BINS).astype(int) + BINS, minlength=2 * BINS + 1)
        at = np.flatnonzero(found)
        return pd.DataFrame({"bin": at - BINS, "n": found[at]})

    shared = spark.sparkContext.broadcast(model)
    tuned_words = totals.where(F.col("kind") == TUNED_WORDS).drop("kind")
    tuning = packs.where(F.col("kind") == TUNED).groupBy("block", "part").cogroup(tuned_words.groupBy("of_block", "of_part"))
    bins = tuning.applyInPandas(weigh, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # no more rows than bins
    mix = _mixture(bins.bin.to_numpy() / PER_UNIT, bins.n.to_numpy())

    def score(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        net = _model(shared)
        results = []
        for row in texts.itertuples():
            pack, c = read(row, words)
            base = np.log10(c + ADDED) - unit
            share = np.where(c > 0, (1 - mix) * 10**base, 0.0)
            out = []
            for a, b in batches_of(pack.sizes):
                each, w = _text_log_probs(net, pack, a, b)
                of_word = share[w]
                mixed = np.log10(mix * np.exp(each) + of_word)
                unseen = np.flatnonzero(of_word == 0)
                mixed[unseen] = np.log10(mix) + each[unseen] / np.log(10)
                starts = np.cumsum(pack.sizes[a:b] + 1) - pack.sizes[a:b] - 1
                out.append(np.stack([np.add.reduceat(z, starts) for z in ((c[w] > 0).astype(float), base[w], mixed)], 1))
            out = np.concatenate(out)
            doc_ids = pd.Series(list(row.doc_ids), dtype="Int64") if whole_numbers else pd.Series(list(row.doc_ids))
            results.append(pd.DataFrame({"doc_id": doc_ids, "held_out": ~np.frombuffer(row.learn, bool), "n_tokens": pack.sizes.astype(np.int64) + 1, "n_known": out[:, 0].astype(np.int64), "train_tokens": n, "base_score": out[:, 1], "score": out[:, 2]}))
        return pd.concat(results) if results else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole_numbers = kind in ("tinyint", "smallint", "int", "bigint")
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packs.groupBy("block", "part").cogroup(totals.drop("kind").groupBy("of_block", "of_part")).applyInPandas(score, result)


#: Kinds of rows of the table of packs.
WORDS, TUNED_WORDS, IDS, BEGINS, SCORED, TUNED = range(6)
#: Bins on each side of 0, and bins of a unit, of the logarithm by which the mixture's weight is fitted.
BINS, PER_UNIT = 1_000, 25

_models: dict[str, AttentionModel] = {}


def _model(shared) -> AttentionModel:
    """The broadcast model, unpacked once per worker."""
    if shared.value["id"] not in _models:
        _models.clear()
        _models[shared.value["id"]] = AttentionModel.from_bytes(shared.value["data"])
    return _models[shared.value["id"]]


def _mixture(ratio: np.ndarray, n: np.ndarray) -> float:
    """The network's weight by EM over words of given log ratios; a half without words."""
    mix, r = 0.5, np.exp(ratio)
    for _ in range(30 if n.sum() else 0):
        mix = float(np.clip((n * (mix * r / (mix * r + 1 - mix))).sum() / n.sum(), 0.02, 0.98))
    return mix


def _fit(texts: DataFrame, ids: pd.DataFrame, train_texts: int, model_path: str | None) -> dict:
    """The model fitted on the learning texts of all packs ``texts``; ids: (kind, h, total), each id's number and of those that begin words."""
    spark = texts.sparkSession
    all_ids, begin_ids = (ids[ids.kind == k] for k in (IDS, BEGINS))
    at, many, begin = all_ids.h.tolist(), all_ids.total.tolist(), begin_ids.h.tolist()

    def counts() -> np.ndarray:
        out = np.zeros(_subwords(model_path).size)
        out[at] = many
        out[Subwords.END] = train_texts
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pack's windows in each round, as their ids; with the first, its pairs (keys as in a part's matrix) and their numbers, a list for each part of the ids."""
        c = counts()
        frequent = _frequent(c)
        for batch in batches:
            for block, part, learn, *columns in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                x = Pack.read(*columns).training(np.frombuffer(learn, bool))
                if not len(x):
                    continue
                k, n = _pairs(x, len(c), frequent)
                id, column = np.divmod(k, 2 * FREQUENT)
                of_part = [np.flatnonzero(id % PARTS == i) for i in range(PARTS)]
                k = id // PARTS * (2 * FREQUENT) + column
                for share, w in enumerate(shares(x, ROUNDS, block)):
                    row = {"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "share": pa.array([share], pa.int32()), "windows": pa.array([_squeezed(w.ravel())], pa.binary())}
                    row |= {name: pa.array([[_squeezed(y[at]) for at in of_part] if share == 0 else []], pa.list_(pa.binary())) for name, y in (("k", k), ("n", n))}
                    yield pa.RecordBatch.from_pydict(row)

    def dense(f: pd.DataFrame) -> np.ndarray:
        """The sum of a part's pairs as one matrix: ids part, part + PARTS, ..."""
        m = np.zeros((-(-_subwords(model_path).size // PARTS), 2 * FREQUENT))
        for k, n in zip(f.k, f.n, strict=True):
            m.ravel()[_unsqueezed(k)] += _unsqueezed(n, np.int64)  # the keys of one are different
        return m

    def add(f: pd.DataFrame) -> pd.DataFrame:
        m = dense(f).ravel()
        at = np.flatnonzero(m)
        return f[["piece", "block"]].head(1).assign(k=[_squeezed(at)], n=[_squeezed(m[at].astype(np.int64))])

    def matrix(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": f.piece.iloc[:1], "m": [dense(f).astype("f4").tobytes()]})

    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counts()
        m, begins, some = np.zeros((len(c), 2 * FREQUENT), "f4"), np.zeros(len(c), bool), False
        for f in frames:
            some |= len(f) > 0
            for part, rows in zip(f.part, f.m, strict=True):
                rows = np.frombuffer(rows, "f4").reshape(-1, 2 * FREQUENT)
                m[part::PARTS] = rows[: len(m[part::PARTS])]
        begins[begin] = True
        if some:
            yield pd.DataFrame({"model": [initial(m, c, begins, opening=_subwords(model_path).opening).to_bytes()]})

    once = texts.select("block", "part", "learn", *Pack.COLUMNS).mapInArrow(windows, "block int, part int, share int, windows binary, k array<binary>, n array<binary>")
    dealt = materialise(once, "windows")  # all rounds read these
    blocks = (texts.agg(F.max("block")).head()[0] or 0) + 1
    pairs = dealt.where("share = 0").select("block", F.posexplode(F.arrays_zip("k", "n")).alias("piece", "p")).select("piece", "block", "p.k", "p.n")
    if blocks > MERGED:
        pairs = pairs.groupBy("piece", F.pmod("block", F.lit(int(blocks**0.5)))).applyInPandas(add, "piece int, block int, k binary, n binary")
    found = pairs.groupBy("piece").applyInPandas(matrix, "part int, m binary").repartition(1).mapInPandas(start, "model binary").head(1)  # PARTS rows
    if not found:
        size = _subwords(model_path).size
        data = AttentionModel(*(np.zeros(s, "f4") for s in ((size, WIDTH), *[(WIDTH, WIDTH)] * 4, 2 * HALF, (WIDTH, CLASSES), CLASSES)), np.zeros(size, np.int64), np.full(size, -np.log(size), "f4"), 0.5, np.full(CLASSES, _subwords(model_path).opening.mean(), "f4")).to_bytes()
        return {"id": uuid.uuid4().hex, "data": data}
    model, steps, rounds = AttentionModel.from_bytes(bytes(found[0][0])), max(1, STEPS // ROUNDS), ROUNDS
    moves = "piece int, block long, part long, rows binary, move binary, seen binary"

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        """The sum of moves of a piece of the weights; each has some of its rows."""
        f = f.sort_values(["block", "part"])
        at = [np.frombuffer(x, np.int32) for x in f["rows"]]
        rows, place = np.unique(np.concatenate(at), return_inverse=True)
        move, seen = np.zeros((len(rows), WIDTH)), np.zeros(len(rows))
        lo = 0
        for r, m, s in zip(at, f.move, f.seen, strict=True):
            to = place[lo : lo + len(r)]  # the rows of one are different
            move[to] += np.frombuffer(m, "f4").reshape(-1, WIDTH)
            seen[to] += np.frombuffer(s, "f4")
            lo += len(r)
        return pd.DataFrame({"piece": f.piece.iloc[:1], "block": f.block.iloc[:1], "part": f.part.iloc[:1], "rows": [rows.tobytes()], "move": [move.astype("f4").tobytes()], "seen": [seen.astype("f4").tobytes()]})

    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model.to_bytes())

        def learn(batches: Iterator[pd.DataFrame], k: int = k, shared=shared) -> Iterator[pd.DataFrame]:
            """A pack's moves in a round, times how often each row of weights was seen; only rows that were."""
            for f in batches:
                for row in f.itertuples():
                    net = AttentionModel.from_bytes(shared.value)
                    old = net.rows()
                    ids, own = take_steps(net, _unsqueezed(row.windows).reshape(-1, 2 * HALF + 1), steps, k, rounds)
                    seen = np.full(len(old), own, "f4")
                    seen[: len(ids)] = ids
                    move = (net.rows() - old) * seen[:, None]
                    out = []
                    for i in range(PARTS):
                        at = np.arange(i, len(seen), PARTS)
                        at = at[seen[at] > 0].astype(np.int32)
                        out.append((i, row.block, row.part, at.tobytes(), move[at].tobytes(), seen[at].tobytes()))
                    yield pd.DataFrame(out, columns=["piece", "block", "part", "rows", "move", "seen"])

        moved = dealt.where(F.col("share") == k).select("block", "part", "windows").mapInPandas(learn, moves)
        if blocks > MERGED:
            moved = moved.groupBy("piece", F.pmod("block", F.lit(int(blocks**0.5)))).applyInPandas(merge, moves)
        weights = model.rows()
        for r in moved.groupBy("piece").applyInPandas(merge, moves).collect():  # the size of the model
            at = np.frombuffer(r["rows"], np.int32)
            weights[at] += np.frombuffer(r.move, "f4").reshape(-1, WIDTH) / np.maximum(np.frombuffer(r.seen, "f4"), 1)[:, None]
        model.set_rows(weights)
    return {"id": uuid.uuid4().hex, "data": model.to_bytes()}


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
