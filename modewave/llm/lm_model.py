"""The model behind the language-model scores: codes of words, counts under contexts, and the mixer. No Spark here.

Every word that the training texts hold twice has a code, a string of bits: first the bits of its class (words of about one frequency),
in a tree that is balanced by the classes' tokens; then the bits of its place among the class' words, in the order of their first letters,
by halving. Other words share the code of class 0, and are then spelled in bytes of 8 bits with an end. So a text is a sequence of binary decisions.

A decision is predicted under several contexts; for each, counts tell how often either bit followed the bits that the symbol has so far:
for words all training tokens, the tokens after the word before, and the tokens of the document so far; for bytes the last 1, 2, 3 and 4 bytes of the
word. Contexts are hashed to 48 bits. The counts' logits are combined by weights that a gate selects,
which says how much two of the contexts have seen, and an adaptive map from the combined logit to the share of ones refines the result. Weights and
map are learned online: a step after some thousand decisions, which are scored before they teach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .chunks import ODD, U64, mix

#: Words that training texts hold fewer times are spelled.
LEAST_SEEN = 2
N_CLASSES = 128
#: A context that holds more than one in HOT of all tokens, and LEAST_HOT at least, is cut: its counts are kept apart for each CUT bits
#: of the symbol, so that no task gets all that follows a frequent word.
HOT, LEAST_HOT, CUT, CUT_STEP = 2000, 1 << 16, 8, 6
ORDERS = (1, 2, 3, 4)
#: How much a context has seen, in steps: the level of each number up to the last step.
LEVELS, DOC_LEVELS, BYTE_LEVELS = (np.searchsorted(steps, np.arange(steps[-1] + 1), side="right") for steps in ((1, 3, 16, 256), (1, 4, 32), (1, 4, 32)))
N_LEVELS, N_DOC_LEVELS, N_BYTE_LEVELS = (int(x[-1]) + 1 for x in (LEVELS, DOC_LEVELS, BYTE_LEVELS))
WORD_GATES = N_LEVELS * N_DOC_LEVELS * 2
BYTE_GATES = N_BYTE_LEVELS**2
DEPTHS = 24
ZSTD = pa.Codec("zstd", compression_level=3)
#: Bits of the hash that names a node within a text.
NODE_BITS = 24
BUCKETS = 33
#: Decisions of a step: few at first, more as the weights settle.
STEP, FIRST_STEP, STEP_SIZE = 0.03, 1 << 11, 1 << 15
#: Tokens, and spelled words, of a slice: its arrays stay in the processor's cache.
SLICE, SPELLED = 4_000, 600
#: Rows of a piece of larger tables, likewise.
PIECE = 1 << 13
SMALL = np.float32(0.3)
NOVEL_CONTEXT, START_CONTEXT = U64(0x51ED270B7F4A7C15), U64(0x2545F4914F6CDD1D)


# ---------------------------------------------------------------- arrays as bytes


def packed(a: np.ndarray) -> bytes:
    """By byte planes, compressed: the upper planes of small numbers cost nothing."""
    a = np.ascontiguousarray(a)
    return ZSTD.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), asbytes=True) if len(a) else b""


def unpacked(data: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


# ---------------------------------------------------------------- codes


def classes(n: np.ndarray) -> np.ndarray:
    """The class of words by their training tokens: two for each doubling; 0 for words that are spelled."""
    n = np.asarray(n, dtype=np.int64)
    return np.where(n >= LEAST_SEEN, np.floor(2 * np.log2(np.maximum(n, 1))), 0).astype(np.intp)


class Codes:
    """What all tasks share, of a fixed size: training tokens and texts, distinct ones, and words and tokens of each class. From these follow the codes."""

    def __init__(self, total: int, distinct: int, texts: int, size: np.ndarray, mass: np.ndarray):
        self.total, self.distinct, self.texts = total, distinct, texts
        self.size = np.maximum(size.astype(np.int64), 1)
        self.mass = mass.astype(np.int64)
        self.head_sym, self.head_len = np.zeros(N_CLASSES, dtype=U64), np.zeros(N_CLASSES, dtype=np.intp)
        logits: list[list[float]] = [[] for _ in range(N_CLASSES)]
        some = [0] + [k for k in range(1, N_CLASSES) if self.mass[k]]

        def split(ks: list[int], sym: int, at: int, above: list[float]) -> None:
            if len(ks) == 1:
                self.head_sym[ks[0]], self.head_len[ks[0]], logits[ks[0]] = sym, at, above
                return
            up = np.cumsum([max(1, int(self.mass[k])) for k in ks])
            cut = 1 + int(np.abs(2 * up[:-1] - up[-1]).argmin())
            now = [*above, float(np.log((up[-1] - up[cut - 1]) / up[cut - 1]))]
            split(ks[:cut], sym, at + 1, now)
            split(ks[cut:], sym | 1 << (63 - at), at + 1, now)

        split(some, 0, 0, [])
        self.head_logit = np.zeros((N_CLASSES, max(1, max(map(len, logits)))), dtype=np.float32)
        for k, own in enumerate(logits):
            self.head_logit[k, : len(own)] = own

    def words(self, n: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words with ``n`` training tokens and place ``index`` in their class: codes (from the highest bit), their lengths, and the logits of all training tokens by word and bit."""
        k = classes(n)
        sym, length = self.head_sym[k].copy(), self.head_len[k].copy()
        lo, hi = np.zeros(len(k), dtype=np.int64), np.where(k > 0, self.size[k], 1)
        deepest = int((length + np.ceil(np.log2(np.maximum(hi, 1))).astype(np.intp)).max(initial=0)) + 1
        logit = np.zeros((len(k), max(deepest, self.head_logit.shape[1])), dtype=np.float32)
        logit[:, : self.head_logit.shape[1]] = self.head_logit[k]
        live = np.flatnonzero(hi > 1)
        while len(live):
            a, b = lo[live], hi[live]
            mid = a + b + 1 >> 1
            one = index[live] >= mid
            logit[live, length[live]] = np.log((b - mid) / (mid - a))
            sym[live] |= one.astype(U64) << (63 - length[live]).astype(U64)
            lo[live], hi[live] = np.where(one, mid, a), np.where(one, b, mid)
            length[live] += 1
            live = live[hi[live] - lo[live] > 1]
        return sym, length, logit

    def cuts(self, n: np.ndarray) -> np.ndarray:
        """How often contexts of ``n`` tokens are cut."""
        hot = max(LEAST_HOT, self.total // HOT)
        return np.where(n > hot, np.ceil(np.log2(np.maximum(n, 1) / hot) / CUT_STEP), 0).astype(np.intp)


# ---------------------------------------------------------------- a block of texts


class Block:
    """Texts as tokens, and the contexts and symbols that they ask counts for.

    ``tokens`` are places among the block's words, of which ``n`` and ``index`` are known; ``sizes`` and ``held`` are of its texts; ``spelled`` are the words
    that are not coded, in order. ``starts``: whether a text begins there (or goes on from another block).
    """

    def __init__(self, codes: Codes, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray, n: np.ndarray, index: np.ndarray, spelled: list[bytes]):
        self.codes, self.tokens, self.sizes, self.held = codes, tokens.astype(np.int64), sizes.astype(np.int64), held.astype(bool)
        self.coded = n >= LEAST_SEEN
        # coded words stand for themselves; all others are one symbol (any of them has its code) and one context
        w, t, other = len(n), tokens.astype(np.int64), np.flatnonzero(~self.coded)
        shown = np.append(np.flatnonzero(self.coded), other[:1])
        code_of = np.full(w, len(shown) - 1)
        code_of[shown] = np.arange(len(shown))
        self.code_sym, self.code_length, self.logit = codes.words(n[shown], index[shown])
        self.sym, self.length, self.code_kind, kind = self.code_sym[code_of], self.code_length[code_of], classes(n[shown]), classes(n)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.taught = np.repeat(~self.held, self.sizes)
        self.code = code_of.astype(np.int32)[t]
        context = np.where(self.coded, np.arange(w, dtype=np.int32), np.int32(w))[np.concatenate([t[:1], t[:-1]])]
        context[self.starts[self.sizes > 0]] = w + 1
        self.context = context
        names = np.append(mix(mix(index.astype(U64) + (kind.astype(U64) << U64(56))) + ODD), [NOVEL_CONTEXT, START_CONTEXT])
        self.cut_of = np.append(codes.cuts(n), codes.cuts(np.array([codes.mass[0], codes.texts])))
        pairs, pair = np.unique(context * np.int64(max(len(shown), 1)) + self.code, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del pair
        ctx, syms, counts, lengths = ([] for _ in range(4))
        asked = ctx, syms, counts, lengths
        of_pair = self._ask_pairs(asked, pairs // max(len(shown), 1), pairs % max(len(shown), 1), names)
        del pairs, names
        of_byte = self._ask_bytes(asked, sum(map(len, ctx)), np.bincount(t, self.taught, w) if w else np.zeros(0), other, spelled)
        self._ask(asked, of_pair, of_byte)

    def _ask_pairs(self, asked, context, code, names) -> np.ndarray:
        """Adds contexts, symbols, counts and lengths of pairs of words. Returns the entry of each pair and number of cuts."""
        ctx, syms, counts, lengths = asked
        sym, length, cuts, name, at = self.code_sym[code], self.code_length[code], self.cut_of[context], names[context], 0
        count = np.bincount(self.pair, self.taught, len(context)).astype(np.int64)
        most = int(cuts.max(initial=0))
        of_pair = np.zeros((len(context), most + 1), dtype=np.int32)
        for k in range(most + 1):
            i = np.flatnonzero((cuts >= k) & ((length > CUT * k) | (k == 0)))
            c, s, rest = name[i], sym[i], length[i] - CUT * k
            if k:
                c = mix(c + mix((s >> U64(64 - CUT * k)) + (U64(k) << U64(56))))
                s = s << U64(CUT * k)
            cut = cuts[i] > k
            s = np.where(cut, s & ~U64((1 << 64 - CUT) - 1), s)
            of_pair[i, k] = at + np.arange(len(i))
            ctx.append(c), syms.append(s), counts.append(count[i]), lengths.append(np.where(cut, np.minimum(rest, CUT), rest).astype(np.uint8))
            at += len(i)
        return of_pair

    def _ask_bytes(self, asked, at, seen, other, spelled) -> np.ndarray:
        """Likewise of the bytes of spelled words: the entry of each order and byte."""
        ctx, syms, counts, lengths = asked
        # words that are spelled, each once where it is taught and once where it isn't
        shown = np.bincount(self.tokens, minlength=len(self.coded))[other] - seen[other] if len(other) else np.zeros(0)
        self.rows = np.concatenate([np.flatnonzero(seen[other] > 0), np.flatnonzero(shown > 0)]) if len(other) else np.zeros(0, dtype=np.intp)
        n_taught = int((seen[other] > 0).sum()) if len(other) else 0
        data = np.frombuffer(b"\n".join([spelled[i] for i in self.rows.tolist()]) + b"\n" if len(self.rows) else b"", dtype=np.uint8)
        sizes = np.array([len(spelled[i]) + 1 for i in self.rows.tolist()], dtype=np.int64)
        self.word_starts = np.cumsum(sizes) - sizes
        self.bytes, self.byte_taught = data.astype(np.intp), np.repeat(np.arange(len(sizes)) < n_taught, sizes)
        place = np.arange(len(data)) - np.repeat(self.word_starts, sizes)
        before, of_byte = np.zeros(len(data), dtype=U64), np.zeros((len(ORDERS), len(data)), dtype=np.int32)
        for k in range(1, ORDERS[-1] + 1):
            back = np.zeros(len(data), dtype=U64)
            back[k:] = data[:-k] if len(data) > k else back[k:]
            back[place < k] = 0
            before |= back << U64(8 * (k - 1))
            if k in ORDERS:
                distinct, of = np.unique(before << U64(8) | data.astype(U64), return_inverse=True)
                of_byte[ORDERS.index(k)] = at + of
                ctx.append(mix(mix((distinct >> U64(8)) + (U64(k) << U64(48))) + U64(k)))
                syms.append(distinct << U64(56)), counts.append(np.bincount(of, self.byte_taught, len(distinct)).astype(np.int64)), lengths.append(np.full(len(distinct), 8, dtype=np.uint8))
                at += len(distinct)
        self.row_of = np.full((2, len(self.coded)), -1, dtype=np.int32)
        self.row_of[0, other[self.rows[:n_taught]]] = np.arange(n_taught)
        self.row_of[1, other[self.rows[n_taught:]]] = np.arange(n_taught, len(self.rows))
        return of_byte

    def _ask(self, asked, of_pair, of_byte) -> None:
        """The entries in order, each once."""
        ctx, syms, counts, lengths = asked
        c, s = np.concatenate(ctx) >> U64(16), np.concatenate(syms)
        ctx.clear(), syms.clear()
        order = np.argsort(c << U64(16) | s >> U64(48), kind="stable")  # an entry may stand twice where symbols agree in 16 bits: both are asked, and told the sum
        c, s = c[order], s[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])][: len(c)]
        entry = np.empty(len(c), dtype=np.int32)
        entry[order] = np.cumsum(new) - 1
        self.ctx, self.syms = c[new], s[new]
        del c, s, order, new
        self.counts = np.bincount(entry, np.concatenate(counts), len(self.ctx)).astype(np.int64)
        counts.clear()
        self.lengths = np.zeros(len(self.ctx), dtype=np.int64)
        self.lengths[entry] = np.concatenate(lengths)
        self.of_pair, self.of_byte = entry[of_pair] if len(entry) else of_pair, entry[of_byte] if len(entry) else of_byte

    def asks(self, n_parts: int) -> list[tuple[int, int, int, bytes]]:
        """(part, contexts, entries, data) of each part that the block asks."""
        out, part = [], (self.ctx >> U64(16)) * U64(n_parts) >> U64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)]).tolist()
        for a, b in zip(first, [*first[1:], len(part)], strict=True):
            c = self.ctx[a:b]
            new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            data = packed_asks(c[new], np.diff(np.r_[new, b - a]), self.syms[a:b], self.counts[a:b])
            out.append((int(part[a]), len(new), b - a, data))
        return out

    # -------------------------------------------------------- with the answers

    def answered(self, u: np.ndarray, n0: np.ndarray, other: np.ndarray) -> None:
        """Takes the answers (see ``totals``) in the order of the entries."""
        self.answered_by([(u, n0, other)])

    def answered_by(self, answers) -> None:
        """Takes the answers to some entries after the other: how often contexts were followed by 0, 1, 2, ... bits of their symbols."""
        size = self.lengths + 1
        self.at = np.cumsum(size) - size
        self.got, done = np.empty(int(size.sum()), dtype=np.float32), 0
        for u, n0, other in answers:
            off = np.cumsum(u) - u
            for a in range(0, len(u), PIECE):
                i, j = slice(a, a + PIECE), slice(done + a, done + min(a + PIECE, len(u)))
                first, told = self.at[j] - self.at[done + a], np.minimum(u[i], self.lengths[j])
                x = np.zeros(int(size[j].sum()), dtype=np.int64)
                x[first] = n0[i]
                x[ragged(first + 1, told)] = -other[ragged(off[i], told)]
                np.cumsum(x, out=x)
                x -= np.repeat(x[first] - n0[i], size[j])
                self.got[self.at[done + a] : self.at[done + a] + len(x)] = x
            done += len(u)
        # of each pair and number of cuts: where its counts begin, less the bits before
        self.begin = (self.at[self.of_pair] if len(size) else self.of_pair) - CUT * np.arange(self.of_pair.shape[1])
        # the words' bits: a node, hashed, for each string of bits that begins a code, with the bit that follows
        depth = np.arange(self.logit.shape[1], dtype=U64)
        mark = U64(1) << (U64(63) - depth)
        self.node = np.empty(self.logit.shape, dtype=np.int32)
        for a in range(0, len(self.node), PIECE):
            sym, head = self.code_sym[a : a + PIECE, None], self.codes.head_len[self.code_kind[a : a + PIECE], None].astype(U64)
            node = (sym & ~((mark << U64(1)) - U64(1))) | mark
            node ^= node >> U64(29)
            node *= ODD
            node >>= U64(64 - NODE_BITS)
            inner, bit = depth >= head, sym >> (U64(63) - depth) & U64(1)  # inner: beyond the class' bits
            self.node[a : a + PIECE] = node << U64(2) | inner.astype(U64) << U64(1) | bit

    def slices(self):
        """Ranges of texts of about SLICE tokens."""
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, int(np.searchsorted(self.ends, (self.ends[a - 1] if a else 0) + SLICE, side="right")))
            yield a, b
            a = b

    def decisions(self):
        """Of each slice: its range of texts and its decisions."""
        for a, b in self.slices():
            yield a, b, Decisions(self, a, b)

    def spellings(self):
        """Of each slice of spelled words: its decisions."""
        for a in range(0, len(self.word_starts), SPELLED):
            yield Spellings(self, a, min(a + SPELLED, len(self.word_starts)))


def history(group: np.ndarray, n_groups: int, node: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each decision: zeros and ones before it with its group and node."""
    n = len(node)
    place = max(1, int(n - 1).bit_length())
    if n_groups < 1 << 62 - place - NODE_BITS:
        key = np.sort((group << NODE_BITS | node) << place + 1 | np.arange(0, 2 * n, 2) | bit)
        order, one, same = key >> 1 & (1 << place) - 1, key & 1, key >> place + 1
    else:
        order = np.lexsort((node, group))
        one, same = bit[order], group[order] * (1 << NODE_BITS) + node[order]
    new = np.flatnonzero(np.r_[True, same[1:] != same[:-1]][:n])
    size = np.diff(np.append(new, n))
    up = np.cumsum(one) - one
    ones = up - np.repeat(up[new], size)
    zeros = np.arange(n) - np.repeat(new, size) - ones
    out = np.empty((2, n), dtype=np.float32)
    out[0][order], out[1][order] = zeros, ones
    return out[0], out[1]


def how_often(x: np.ndarray) -> np.ndarray:
    """For each element, not negative: how many are equal to it."""
    place = int(len(x)).bit_length()
    if not len(x) or int(x.max()).bit_length() + place < 63:
        k = np.sort(x << place | np.arange(len(x)))
        order, k = k & (1 << place) - 1, k >> place
    else:
        order = np.argsort(x, kind="stable")
        k = x[order]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    size = np.diff(np.append(new, len(k)))
    out = np.empty(len(k), dtype=np.int64)
    out[order] = np.repeat(size, size)
    return out


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + SMALL) / (zeros + SMALL))


def level(n: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return steps.take(np.minimum(n, np.float32(len(steps) - 1)).astype(np.intp))


def followed(got: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers after each place, and at it. Places run on, mostly."""
    here = got.take(place)
    after = np.empty_like(here)
    after[:-1] = here[1:]
    jump = np.flatnonzero(np.diff(place, append=-1) != 1)
    after[jump] = got.take(place[jump] + 1)
    return after, here


class Decisions:
    """The decisions of a range of a block's texts: inputs of the mixer, gates, places of the refining map, bits, and where each token's begin.

    Where a training text's word follows another, the text's own such pairs are taken off the counts, so that it doesn't predict itself.
    """

    def __init__(self, block: Block, a: int, b: int):
        x, y = int(block.starts[a]), int(block.ends[b - 1])
        code, pair = block.code[x:y].astype(np.int64), block.pair[x:y]
        length = block.code_length[code]
        first = np.cumsum(length) - length
        here = np.arange(int(length.sum()))
        each = lambda of_token: np.repeat(of_token, length)
        ends = np.append(first, len(here))[block.ends[a:b] - x]
        of_text = lambda x: np.repeat(x, np.diff(np.append(0, ends)))
        at = each(code * block.logit.shape[1] - first)
        at += here
        node = block.node.reshape(-1).take(at).astype(np.int64)
        bit = node & 1
        depth = here - each(first)
        place = each(block.begin[pair, 0] - first)
        place += here
        cuts = block.cut_of[block.context[x:y]]
        cut = np.flatnonzero((cuts > 0) & (length > CUT))
        if len(cut):  # beyond the bits before the first cut
            more = length[cut] - CUT
            i, token = ragged(first[cut] + CUT, more), np.repeat(cut, more)
            place[i] = block.begin[pair[token], np.minimum(depth[i] // CUT, cuts[token])] + depth[i]
        own, other = followed(block.got, place)
        other -= own
        held = block.held[a:b]
        if not held.all():
            text = np.repeat(np.arange(b - a), block.sizes[a:b])
            less = np.where(block.taught[x:y], how_often(text * block.of_pair.shape[0] + pair), 0).astype(np.float32)
            own = np.maximum(own - each(less), 0)
        zeros, ones = history(of_text(np.arange(b - a)), b - a, node >> 2, bit)
        self.sign = (2 * bit - 1).astype(np.float32)
        self.inputs = np.empty((3, len(here)), dtype=np.float32).T  # one input after the other
        self.inputs[:, 0] = block.logit.reshape(-1).take(at)
        self.inputs[:, 1] = logits(other, own) * self.sign
        self.inputs[:, 2] = logits(zeros, ones)
        seen = level(own + other, LEVELS)
        self.gate = (seen * N_DOC_LEVELS + level(zeros + ones, DOC_LEVELS)) * 2 + (node >> 1 & 1)
        self.place = np.minimum(depth, DEPTHS - 1) * N_LEVELS + seen
        self.bit, self.taught, self.first, self.length = bit, of_text((~held).astype(np.float32)), first, length


class Spellings:
    """The decisions of a range of the words that are spelled, in the same form. Where a word is taught, its own bytes are taken off."""

    def __init__(self, block: Block, a: int, b: int):
        ends = np.append(block.word_starts, len(block.bytes))
        first, n = int(ends[a]), int(ends[b] - ends[a])
        depth, byte = np.tile(np.arange(8), n), np.repeat(np.arange(first, first + n), 8)
        value = block.bytes[byte]
        self.bit = value >> (7 - depth) & 1
        self.taught = block.byte_taught[byte].astype(np.float32)
        self.inputs = np.empty((len(ORDERS), 8 * n), dtype=np.float32).T
        self.sign = (2 * self.bit - 1).astype(np.float32)
        for i, of in enumerate(block.of_byte):
            counts = block.got.take(block.at[of[first : first + n], None] + np.arange(9))
            own = np.ascontiguousarray(counts[:, 1:]).reshape(-1)
            other, own = (counts[:, :-1] - counts[:, 1:]).reshape(-1), np.maximum(own - self.taught, 0)
            self.inputs[:, i] = logits(other, own) * self.sign
            third, seen = (seen if i else None), level(other + own, BYTE_LEVELS)
        self.gate = depth * BYTE_GATES + third * N_BYTE_LEVELS + seen
        self.place = (1 << depth) | value >> (8 - depth)
        self.length = 8 * np.diff(ends[a : b + 1])
        self.first = np.cumsum(self.length) - self.length


# ---------------------------------------------------------------- the mixer


class Mixer:
    """Weights by gate and input, and the refining map by place and bucket of the logit: zeros and ones."""

    def __init__(self, n_gates: int, n_inputs: int, n_places: int):
        self.done = 0
        self.weights = np.full((n_inputs, n_gates), 0.4)
        self.moved = np.full((n_inputs, n_gates), 1e-3)
        centre = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2))
        self.map = np.stack([np.tile(1 - centre, n_places), np.tile(centre, n_places)]) * 8

    def ones_of(self, inputs: np.ndarray, gate: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of a one: the mean of the mixed and the refined one, which is read between two buckets of the map. Also the mixed one, and the nearest cell of the map."""
        x = np.zeros(len(gate), dtype=np.float32)
        for own, weights in zip(inputs.T, self.weights.astype(np.float32), strict=True):
            x += own * weights.take(gate)
        mixed = 1 / (1 + np.exp(-x))
        at = np.clip(2 * x + np.float32(BUCKETS // 2), 0, np.float32(BUCKETS - 1.01))
        low = at.astype(np.intp)
        part, cell = at - low.astype(np.float32), place * BUCKETS + low
        share = (self.map[1] / (self.map[0] + self.map[1])).astype(np.float32)
        refined = share.take(cell) * (1 - part) + share.take(cell + 1) * part
        return np.clip((mixed + refined) / 2, 1e-6, 1 - 1e-6), mixed, cell + (part >= 0.5)

    def bits(self, d: Decisions | Spellings) -> np.ndarray:
        """Of each token: its cost in bits. Online: decisions are scored in order, and those that are taught teach after every step."""
        cost = np.empty(len(d.bit) + 1)
        cost[-1] = 0.0
        n, size = self.weights.shape[1], self.map.shape[1]
        a = 0
        while a < len(d.bit):
            i = slice(a, a + min(STEP_SIZE, max(FIRST_STEP, self.done // 8)))
            inputs, gate, bit, sign, taught = d.inputs[i], d.gate[i], d.bit[i], d.sign[i], d.taught[i]
            p, mixed, cell = self.ones_of(inputs, gate, d.place[i])
            cost[a : a + len(bit)] = -np.log2(np.float32(0.5) + sign * (p - np.float32(0.5)))
            a += len(bit)
            self.done += len(bit)
            if not taught.any():
                continue
            miss = ((sign + 1) / 2 - mixed) * taught
            total = np.bincount(gate, taught, n) + 1e-9
            g = np.stack([np.bincount(gate, miss * own, n) for own in inputs.T]) / total
            self.moved += g * g
            self.weights += STEP * g / np.sqrt(self.moved)
            self.map += np.bincount(bit * size + cell, taught, 2 * size).reshape(2, size)
        return np.where(d.length > 0, np.add.reduceat(cost, d.first), 0.0) if len(d.first) else np.zeros(0)


class Model:
    """The mixers of words and of bytes, as they are before they have learned."""

    def __init__(self) -> None:
        self.words = Mixer(WORD_GATES, 3, DEPTHS * N_LEVELS)
        self.bytes = Mixer(8 * BYTE_GATES, len(ORDERS), 256)

    def scores(self, block: Block) -> np.ndarray:
        """Bits of each text of the block, in order; its training texts teach."""
        spelled = np.concatenate([np.zeros(0), *(self.bytes.bits(d) for d in block.spellings())])
        out = np.zeros(len(block.sizes))
        for a, b, d in block.decisions():
            x, y = int(block.starts[a]), int(block.ends[b - 1])
            cost = self.words.bits(d)
            row = block.row_of[np.where(block.taught[x:y], 0, 1), block.tokens[x:y]]
            if len(spelled):
                cost += np.where(row >= 0, spelled[row], 0)
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), block.sizes[a:b]), cost, b - a)
        return out


# ---------------------------------------------------------------- counts


def packed_asks(ctx: np.ndarray, runs: np.ndarray, syms: np.ndarray, counts: np.ndarray) -> bytes:
    parts = [packed(np.diff(ctx, prepend=U64(0))), packed(runs.astype(np.uint32)), packed(syms), packed(counts)]
    return np.array([len(p) for p in parts], dtype=np.int32).tobytes() + b"".join(parts)


def opened_asks(data: bytes, n_ctx: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, symbols and counts of the entries."""
    parts, at = [], 16
    for size in np.frombuffer(data[:16], dtype=np.int32).tolist():
        parts.append(data[at : at + size])
        at += size
    ctx = np.cumsum(unpacked(parts[0], n_ctx, U64), dtype=U64)
    return np.repeat(ctx, unpacked(parts[1], n_ctx, np.uint32)), unpacked(parts[2], n, U64), unpacked(parts[3], n, np.int64)


def agreeing(ctx: np.ndarray, syms: np.ndarray) -> np.ndarray:
    """Of each entry: how many bits its symbol shares with that of the entry before; -1 where its context is another one."""
    apart = syms[1:] ^ syms[:-1]
    high, low = (np.frexp(x.astype(np.float64))[1].astype(np.int64) for x in (apart >> U64(32), apart & U64(0xFFFFFFFF)))
    bits = np.where(ctx[1:] == ctx[:-1], 64 - np.where(high > 0, 32 + high, low), -1)
    return np.r_[-1, bits][: len(ctx)]


def in_order(ctx: np.ndarray, syms: np.ndarray) -> np.ndarray:
    """Orders entries by context (of 48 bits), then by symbol: one key of both, and the few whose keys agree but not their symbols are ordered once more."""
    key = ctx << U64(16) | syms >> U64(48)
    order = np.argsort(key)
    k, s = key[order], syms[order]
    same = k[1:] == k[:-1]
    unlike = np.flatnonzero(same & (s[1:] != s[:-1]))
    if len(unlike):
        group = np.cumsum(np.r_[0, ~same])
        mixed = np.zeros(int(group[-1]) + 1, dtype=bool)
        mixed[group[unlike]] = True
        again = np.flatnonzero(mixed[group])
        order[again] = order[again][np.lexsort((s[again], k[again]))]
    return order


def totals(ctx: np.ndarray, syms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adds up the entries of all blocks. Of each given entry: its distinct one; of each distinct one: the bits after which it is alone in its context (u),
    how often the context was seen, and (u of them, one entry after the other) how often the other bit was seen at each of those."""
    order = in_order(ctx, syms)
    c, s = ctx[order], syms[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])][: len(c)]
    of = np.empty(len(c), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    c, s = c[new], s[new]
    n = np.bincount(of, counts, len(c)).astype(np.int64)
    shared = agreeing(c, s)
    u, n0 = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
    live, levels, d = np.arange(len(c)), [], 0
    before = None
    while len(live):
        start = np.r_[True, (live[1:] != live[:-1] + 1) | (shared[live[1:]] < d)]
        first = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        total = np.add.reduceat(n[live], first)[run]
        if d == 0:
            n0[live] = total
        else:
            levels.append((live, before[live] - total))
        u[live] = d
        now = np.zeros(len(c), dtype=np.int64) if before is None else before
        now[live] = total
        before = now
        alone = (np.diff(np.r_[first, len(live)]) == 1)[run]
        live, d = live[~alone], d + 1
    off = np.cumsum(u) - u
    other = np.zeros(int(u.sum()), dtype=np.int64)
    for k, (i, x) in enumerate(levels):
        other[off[i] + k] = x
    return of, u, n0, other


def told_once(ctx: np.ndarray, syms: np.ndarray, u: np.ndarray, off: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The numbers of ``other`` that each entry's answer needs (``u`` of them from ``off``) but for those that the entry before it has too: at the bits that both share."""
    known = np.maximum(agreeing(ctx, syms), 0)
    return other[ragged(off + known, u - known)]


def told_whole(ctx: np.ndarray, syms: np.ndarray, u: np.ndarray, told: np.ndarray) -> np.ndarray:
    """The numbers of all entries, one after the other, from those of ``told_once``."""
    known, off = np.maximum(agreeing(ctx, syms), 0), np.cumsum(u) - u
    out = np.empty(int(u.sum()), dtype=np.int64)
    out[ragged(off + known, u - known)] = told
    live, d = np.flatnonzero(known > 0), 0
    while len(live):
        new = np.flatnonzero(np.r_[True, live[1:] != live[:-1] + 1])
        out[off.take(live) + d] = np.repeat(out.take(off.take(live.take(new) - 1) + d), np.diff(new, append=len(live)))
        d += 1
        live = live[known.take(live) > d]
    return out


def packed_answer(u: np.ndarray, n0: np.ndarray, other: np.ndarray) -> bytes:
    parts = [packed(u.astype(np.uint8)), packed(np.diff(n0, prepend=0)), packed(other)]
    return np.array([len(p) for p in parts] + [len(other)], dtype=np.int32).tobytes() + b"".join(parts)


def opened_answer(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    *sizes, n_other = np.frombuffer(data[:16], dtype=np.int32).tolist()
    a, b, c = (data[16 : 16 + sizes[0]], data[16 + sizes[0] : 16 + sizes[0] + sizes[1]], data[16 + sizes[0] + sizes[1] :])
    return unpacked(a, n, np.uint8).astype(np.int64), np.cumsum(unpacked(b, n, np.int64)), unpacked(c, n_other, np.int64)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
