"""Language-model scoring by a hierarchical Pitman-Yor model: a restaurant for the two words before, above it one for the word before, above all of them one of words over a uniform base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import LOWER, flat, groups_for, mix, signed, slices, span_hashes, spans

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_TRAIN = np.uint16(1 << 15)


@dataclass(frozen=True)
class Config:
    per_group: int = 1_600_000  # tokens whose restaurants are in one task, about
    least_share: int = 1024  # restaurants of more than 1 / share of all tokens are counted before; share grows with the tasks
    most_share: int = 1 << 20
    burn_in: int = 2
    samples: int = 3
    root_mass: float = 0.5  # of each word in the root's base
    exact_customers: int = 1024  # the tables of a dish with more customers are drawn from the limit of their law
    batch_bytes: int = 4 << 20
    seed: int = 17


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, hashes of the word before and of the one before that, and text number of each token; each text ends in END."""
    data, at = flat(batch.column("text"))
    n = len(at) - 1
    start, end, own = spans(data, at)
    words = span_hashes(data, start, end, LOWER)
    count = np.bincount(own, minlength=n) + 1
    ends = np.cumsum(count)
    word = np.full(ends[-1] if n else 0, END, np.uint64)
    body = np.ones(len(word), bool)
    body[ends - 1] = False
    word[body] = words
    before, second = np.full(len(word), START), np.full(len(word), START)
    before[1:], second[2:] = word[:-1], word[:-2]
    before[ends - count] = START
    second[ends - count] = START
    second[(ends - count + 1)[count > 1]] = START
    return word, before, second, np.repeat(np.arange(n), count)


def log_stirling(most: int, d: float) -> np.ndarray:
    """[c, t]: the log of the sum over all ways to seat c customers at t tables of the product of (1 - d)(2 - d)...(n - 1 - d) for each table of n."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 2)
    with np.errstate(divide="ignore"):
        for c in range(most):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - d * t, 0)))
    return out


class Tables:
    """Draws the number of tables of dishes from its full conditional: for c customers and weight a of a new table P(t) is as a^t times the generalised Stirling number of c and t."""

    def __init__(self, d: float, most: int, chunk: int = 1 << 18):
        self.d, self.chunk = d, chunk
        self.log_s = log_stirling(most, d)
        self.most = most

    def draw(self, c: np.ndarray, a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = np.minimum(c, 1)
        u, log_a = rng.random(len(c)), np.log(np.maximum(a, 1e-300))
        some = np.flatnonzero((c > 1) & (c <= self.most))
        some = some[np.argsort(c[some], kind="stable")]
        sizes, begin = np.unique(c[some], return_index=True)
        for size, i, j in zip(sizes.tolist(), begin.tolist(), np.append(begin, len(some))[1:].tolist(), strict=True):
            step = max(1, self.chunk // size)
            for k in range(i, j, step):
                rows = some[k : min(j, k + step)]
                weight = self.log_s[size, 1 : size + 1] + log_a[rows, None] * np.arange(1, size + 1)
                weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
                out[rows] = 1 + (weight < u[rows, None] * weight[:, -1:]).sum(1)
        large = np.flatnonzero(c > self.most)
        out[large] = np.minimum(c[large], 1 + rng.poisson(a[large] / self.d))  # where c is large the law tends to this
        return out


def discount_of(counts: np.ndarray) -> float:
    """From how many dishes have one and two customers, with a few seen before any."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip((once + 6) / (once + 2 * twice + 8), 0.1, 0.95))


def strength_of(customers: np.ndarray, tables: np.ndarray, discount: float) -> float:
    """The restaurants' common strength, by a few steps of expectation over the usual auxiliary variables, with a Gamma(1, 1) prior."""
    some = customers > 1
    c, t, strength = customers[some], np.maximum(tables[some], 1), 1.0
    for _ in range(20):
        r = strength / discount
        opened = (r * np.log((r + t) / (r + 1)) + 1).sum()
        strength = float((1 + opened) / (1 + np.log((strength + c) / (strength + 1)).sum()))
    return strength


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns that are ordered."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def numbered(new: np.ndarray) -> np.ndarray:
    """From 0, of each place where a combination begins or goes on."""
    return np.cumsum(new, dtype=np.int32) - np.int32(1)


class Part:
    """One task's restaurants: leaves for two words before, and above them one for each word before; whole but for the root, which all tasks share.

    Tokens come as context (the word before), leaf (class of the word before that, within the context) and word, each a
    number; those that `learn` seat a customer. family: of each context, in order, the one that it is a share of, else 0.
    """

    def __init__(self, context: np.ndarray, leaf: np.ndarray, word: np.ndarray, learn: np.ndarray, family: np.ndarray, n_words: int, config: Config, seed: tuple[int, ...]):
        self.config, self.rng, self.n_words = config, np.random.default_rng(seed), n_words
        order = np.lexsort((word, leaf, context))
        context, leaf, word = context[order], leaf[order], word[order]
        new = firsts(context, leaf, word)
        self.type_of = np.empty(len(order), np.int32)  # of each token; a task has far less than 2^31
        self.type_of[order] = numbered(new)
        n_types = int(new.sum())
        self.count = np.bincount(self.type_of[learn], minlength=n_types).astype(np.int32)
        context, leaf, self.word = context[new], leaf[new], word[new].astype(np.int32)
        del order, word
        self.leaf, top = numbered(firsts(context, leaf)), numbered(firsts(context))
        del context, leaf
        by_dish = np.lexsort((self.word, top))
        new = firsts(top[by_dish], self.word[by_dish])
        self.dish = np.empty(n_types, np.int32)
        self.dish[by_dish] = numbered(new)
        self.dish_word, self.dish_top = self.word[by_dish][new], top[by_dish][new]
        self.n_leaves, self.n_tops = int(self.leaf[-1]) + 1, int(top[-1]) + 1
        self.dish_family, self.families = family[self.dish_top], np.unique(family[family > 0])
        self.leaf_total = self._sum(self.leaf, self.count, self.n_leaves)
        self.words_seen = np.bincount(self.word, weights=self.count, minlength=n_words).astype(np.int64)
        # each dish begins with one table
        self.t = np.minimum(self.count, 1)
        self.above = self._sum(self.dish, self.t, len(self.dish_word))
        self.above_t = np.minimum(self.above, 1)
        self.d, self.above_d = discount_of(self.count), discount_of(self.above)
        self.draw, self.above_draw = (Tables(d, int(min(config.exact_customers, max(2, c.max(initial=0))))) for d, c in ((self.d, self.count), (self.above_d, self.above)))

    @staticmethod
    def _sum(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n).astype(np.int64)

    def _totals(self) -> None:
        self.leaf_t = self._sum(self.leaf, self.t, self.n_leaves)
        self.top_total, self.top_t = self._sum(self.dish_top, self.above, self.n_tops), self._sum(self.dish_top, self.above_t, self.n_tops)
        self.strength = strength_of(self.leaf_total, self.leaf_t, self.d)
        self.above_strength = strength_of(self.top_total, self.top_t, self.above_d)

    def _above(self, customers: np.ndarray, tables: np.ndarray, dish: np.ndarray, parent: np.ndarray) -> np.ndarray:
        top = self.dish_top[dish]
        return (customers - self.above_d * tables + (self.above_strength + self.above_d * self.top_t[top]) * parent[dish]) / (self.above_strength + self.top_total[top])

    def sweep(self, parent: np.ndarray) -> None:
        """One Gibbs sweep: a gamma variable for each restaurant, given which its dishes are independent; then the tables of all dishes from their full conditionals, leaves first. parent: the probability of each dish's word one level up."""
        self._totals()
        many = np.flatnonzero(self.count > 1)
        extra = self.t[many] - 1  # the dish's own further tables don't vouch for it above
        customers = self.above[self.dish[many]] - extra
        p = self._above(customers, np.minimum(self.above_t[self.dish[many]], customers), self.dish[many], parent)
        weight = self.rng.gamma(self.strength / self.d + self.leaf_t)
        self.t[many] = self.draw.draw(self.count[many], self.d * weight[self.leaf[many]] * p, self.rng)
        self.above = self._sum(self.dish, self.t, len(self.above))
        weight = self.rng.gamma(self.above_strength / self.above_d + self.top_t)
        self.above_t = self.above_draw.draw(self.above, self.above_d * weight[self.dish_top] * parent, self.rng)

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        """The probability of each type's word after its two words."""
        self._totals()
        p = self._above(self.above, self.above_t, np.arange(len(self.above)), parent)[self.dish]
        total, tables = self.leaf_total[self.leaf], self.leaf_t[self.leaf]
        return np.where(total > 0, (self.count - self.d * self.t + (self.strength + self.d * tables) * p) / (self.strength + np.maximum(total, 1)), p)

    def own_root(self) -> np.ndarray:
        """The dishes' words in a root of this task alone, for the first sweeps."""
        own = np.bincount(self.dish_word, weights=self.above_t, minlength=self.n_words) + self.config.root_mass
        return own[self.dish_word] / (own.sum() + self.config.root_mass)

    def root_customers(self) -> np.ndarray:
        """Of each word, but for the tables in shares of a context: these are customers of the whole one."""
        return self._sum(self.dish_word, np.where(self.dish_family == 0, self.above_t, 0), self.n_words)

    def shared_dishes(self, owner: np.ndarray) -> np.ndarray:
        """Dishes of contexts that are dealt to several restaurants, in order of owner (of each word), family and word."""
        some = np.flatnonzero(self.dish_family)
        return some[np.lexsort((self.dish_word[some], self.dish_family[some], owner[self.dish_word[some]]))]


def whole_context(customers: np.ndarray, root: np.ndarray, total: np.ndarray, words: np.ndarray, once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """The probability of words in restaurants that several shares have as their parent, with one table a dish: of each word its customers and probability in the root, and of its restaurant all customers, words, and words with one and two customers."""
    kinds, of = np.unique(np.stack([total, words, once, twice]), axis=1, return_inverse=True)
    d = np.clip((kinds[2] + 6) / (kinds[2] + 2 * kinds[3] + 8), 0.1, 0.95)
    strength = np.array([strength_of(c[None], t[None], x) for c, t, x in zip(kinds[0], kinds[1], d, strict=True)])
    d, strength = d[of.ravel()], strength[of.ravel()]
    return (customers - d * np.minimum(customers, 1) + (strength + d * words) * root) / (strength + total)


def _bytes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, so that the shuffle's compression finds the many zeros among the last."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _array(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Of rising numbers: the first and the steps."""
    return _bytes(np.diff(x, prepend=x.dtype.type(0)))


def _narrow(x: np.ndarray) -> bytes:
    return _bytes(x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32))


def _wide(data: bytes, n: int) -> np.ndarray:
    """n numbers as _narrow left them."""
    return _array(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int32)


def _rows(group: pa.Table, name: str, kind: type, rising: bool = False) -> list[np.ndarray]:
    arrays = [_array(x, kind) for x in group[name].to_pylist()]
    return [np.cumsum(x, dtype=kind) for x in arrays] if rising else arrays


def _all(group: pa.Table, name: str, kind: type, rising: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *_rows(group, name, kind, rising)])


def model_scores(docs: DataFrame, train: Column, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Tokens are lower-cased (A-Z) words outside ASCII white space and one end token; null text counts as empty and has the
    end token alone. The model learns from rows where `train` is true (null: false). Nulls and repeats among ids are of no
    effect: each row is scored. An empty table gives an empty result; other columns are ignored; reruns agree.

    Three levels: a restaurant for each pair of words before (of the first a 16-bit class within the second's), above it
    one for the word before (a 64-bit hash, of which a task and 32 bits are kept), and the root of all words, a process
    of discount 0 whose base gives each training word, and all others as one, the same. Tokens shuffle once, by the word
    before, so a task holds whole restaurants of both lower levels and seats their customers by Gibbs sampling. A
    restaurant of more than a quarter of a task's tokens is dealt to several by the class of the word before that, and a
    pair that is still too frequent by text; the shares have one parent, the restaurant of the whole context, which stands
    between them and the root. First the tasks sweep with roots of their own words. The tables that come out, added up
    over all tasks, are the customers of the whole contexts (each of whose dishes has one table) and of the root. Then the
    tasks sweep anew under these, and each token is scored by its predictive probability averaged over samples.
    base_score is that of the smoothed unigram counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    result = f"{id_col} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, learned = 0, 0
        for batch in slices(batches, "text", config.batch_bytes, 1 << 15):
            data, at = flat(batch.column("text"))
            count = np.bincount(spans(data, at)[2], minlength=batch.num_rows) + 1
            n, learned = n + int(count.sum()), learned + int(count[batch.column("train").to_numpy(zero_copy_only=False)].sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "learned": pa.array([learned])})

    total = rows.mapInArrow(sizes, "n long, learned long").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned")).first()
    if not total["n"]:
        return spark.createDataFrame([], result)
    n_all, n_train = total["n"], total["learned"]
    n_groups, owners = groups_for(n_all, config.per_group), groups_for(n_all, 4 * config.per_group)
    share, room = min(config.most_share, max(config.least_share, 8 * n_all // config.per_group)), max(1, config.per_group // 4)

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", config.batch_bytes, 1 << 15):
            word, before, second, _ = tokens_of(batch)
            for level, keys in ((0, before), (1, pair_of(before, second))):
                keys, n = np.unique(keys, return_counts=True)
                often = n * share > len(word)
                yield pa.RecordBatch.from_pydict({"level": pa.array(np.full(int(often.sum()), level, np.int32)), "key": pa.array(signed(keys[often])), "n": pa.array(n[often])})

    hot: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * 2
    if n_all > room:
        found = rows.mapInArrow(census, "level int, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n")).filter(F.col("n") > max(room, n_all // share)).collect()  # at most `share` of each level
        for level in (0, 1):
            some = sorted((r["key"] & (1 << 64) - 1, -(-r["n"] // room)) for r in found if r["level"] == level)
            hot[level] = tuple(np.array([x[i] for x in some], np.uint64) for i in (0, 1))

    def shares(level: int, keys: np.ndarray) -> np.ndarray:
        """Over how many restaurants each is dealt."""
        known, n = hot[level]
        if not len(known):
            return np.ones(len(keys), np.uint64)
        to = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[to] == keys, n[to], np.uint64(1))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each batch of texts and part; the texts' ids and sizes go with its first row."""
        for number, batch in enumerate(slices(batches, "text", config.batch_bytes, 1 << 15)):
            word, before, second, own = tokens_of(batch)
            n = batch.num_rows
            size = np.bincount(own, minlength=n)
            leaf = (mix(second) >> np.uint64(48)).astype(np.uint16)
            split, again = shares(0, before), shares(1, pair_of(before, second))
            context = before + leaf % split
            if (again > 1).any():
                text = mix(np.add.reduceat(word, np.cumsum(size) - size))  # copies of a text stay together
                context = context + mix(text[own] % again)
            dealt = (split > 1) | (again > 1)
            context, family = np.where(dealt, mix(context), before), np.where(dealt, before, np.uint64(0))
            part = ((context >> np.uint64(32)) % np.uint64(n_groups)).astype(np.int32)
            low = context.astype(np.uint32)
            order = np.lexsort((word, leaf, low, part))
            part, low, leaf, word, family = part[order], low[order], leaf[order], word[order], family[order]
            text = own[order].astype(np.uint16) | np.where(batch.column("train").to_numpy(zero_copy_only=False), _TRAIN, np.uint16(0))[own[order]]
            begin = np.flatnonzero(firsts(part))
            ends = np.append(begin[1:], len(part))
            columns: dict[str, list[bytes]] = {c: [] for c in ("contexts", "families", "runs", "leaf", "words", "word", "text")}
            for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
                first = np.flatnonzero(firsts(low[a:b]))
                words, at = np.unique(word[a:b], return_inverse=True)
                for c, x in zip(columns, (_steps(low[a:b][first]), _bytes(family[a:b][first]), _bytes(np.diff(np.append(first, b - a)).astype(np.uint32)), _bytes(leaf[a:b]), _steps(words), _narrow(at), _bytes(text[a:b])), strict=True):
                    columns[c].append(x)
            once = np.concatenate([[0], np.full(len(begin), n)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(part[begin]), "batch": pa.array(np.full(len(begin), TaskContext.get().partitionId() << 32 | number))}
                | {c: pa.array(x, pa.binary()) for c, x in columns.items()}
                | {"ids": pa.ListArray.from_arrays(pa.array(once), batch.column("id")), "sizes": pa.ListArray.from_arrays(pa.array(once), pa.array(size))}
            )

    def part_of(group: pa.Table, step: int) -> tuple[Part, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A task's restaurants, its distinct words and where each owner's end, the text number of each token, and where each row's tokens end."""
        group_words = _rows(group, "words", np.uint64, True)
        text = _all(group, "text", np.uint16)
        per_row = np.array([len(x) // 2 for x in group["text"].to_pylist()])
        begins = np.cumsum([0, *map(len, group_words)], dtype=np.int32)
        number = np.concatenate([_wide(x, n) + b for x, n, b in zip(group["word"].to_pylist(), per_row.tolist(), begins[:-1], strict=True)])
        every = np.concatenate(group_words)
        order = np.lexsort((every, every % np.uint64(owners)))
        new = firsts(every[order])
        rank = np.empty(len(every), np.int32)
        rank[order] = numbered(new)
        words = every[order][new]
        context = _all(group, "contexts", np.uint32, True)
        family = _all(group, "families", np.uint64)[np.unique(context, return_index=True)[1]]
        context = np.repeat(context, _all(group, "runs", np.uint32))
        out = Part(context, _all(group, "leaf", np.uint16), rank[number], text >= _TRAIN, family, len(words), config, (config.seed, step, group["part"][0].as_py()))
        return out, words, np.searchsorted(words % np.uint64(owners), np.arange(owners), side="right"), text & ~_TRAIN, np.cumsum(per_row)

    def seat(group: pa.Table) -> pa.Table:
        """Sweeps with the task's own root; a row for each owner of words, with the customers that the root gets and the counts of the words."""
        part, words, ends, *_ = part_of(group, 0)
        for _ in range(config.burn_in):
            part.sweep(part.own_root())
        customers, counts = part.root_customers(), part.words_seen
        shared = part.shared_dishes(np.searchsorted(ends, np.arange(len(words)), side="right"))
        dish_word, at = part.dish_word[shared], np.searchsorted(np.searchsorted(ends, part.dish_word[shared], side="right"), np.arange(owners + 1))
        cuts = [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))]
        return pa.table(
            {"owner": pa.array([i for i, _, _ in cuts], pa.int32()), "part": pa.array([group["part"][0].as_py()] * len(cuts), pa.int32())}
            | {c: pa.array([pack(x[a:b]) for _, a, b in cuts], pa.binary()) for c, x, pack in (("words", words, _steps), ("customers", customers, _bytes), ("counts", counts, _bytes))}
            | {"held": pa.array([_bytes(part.families)] * owners, pa.binary())}
            | {"families": pa.array([_bytes(part.dish_family[shared[at[i] : at[i + 1]]]) for i, _, _ in cuts], pa.binary())}
            | {"dishes": pa.array([_bytes((dish_word[at[i] : at[i + 1]] - a).astype(np.uint32)) for i, a, _ in cuts], pa.binary())}
            | {"tables": pa.array([_bytes(part.above_t[shared[at[i] : at[i + 1]]].astype(np.uint32)) for i, _, _ in cuts], pa.binary())}
        )

    def root(group: pa.Table) -> pa.Table:
        """Sums over all tasks, for each of them in the order of its words and shared dishes; with the owner's totals, and those of each shared context that the task holds: its tables, and its words with any, one and two of them."""
        words, at = np.unique(_all(group, "words", np.uint64, True), return_inverse=True)
        customers, counts = (np.bincount(at, weights=_all(group, c, np.int64), minlength=len(words)).astype(np.int64) for c in ("customers", "counts"))
        ends = np.cumsum([len(x) // 8 for x in group["words"].to_pylist()])
        each = np.array([len(x) // 8 for x in group["families"].to_pylist()])
        known, family = np.unique(_all(group, "families", np.uint64), return_inverse=True)
        dish, of = np.unique(family * len(words) + at[_all(group, "dishes", np.uint32) + np.repeat(ends - np.diff(ends, prepend=0), each)], return_inverse=True)
        tables = np.bincount(of, weights=_all(group, "tables", np.uint32), minlength=len(dish)).astype(np.int64)
        customers += np.bincount(dish[tables > 0] % max(1, len(words)), minlength=len(words))  # one table a dish
        sums = np.stack([np.bincount(dish // max(1, len(words)), weights=x, minlength=len(known) + 1).astype(np.int64) for x in (tables, tables > 0, tables == 1, tables == 2)])
        held = [_array(x, np.uint64) for x in group["held"].to_pylist()]
        place = [np.where(np.isin(x, known), np.searchsorted(known, x), len(known)) for x in held]  # the last sum is of nothing
        cut_at = lambda x, ends: [x[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.table(
            {"part": group["part"], "owner": group["owner"], "vocabulary": pa.array([int((counts > 0).sum())] * group.num_rows), "total": pa.array([int(customers.sum())] * group.num_rows)}
            | {c: pa.array([_bytes(x[i]) for i in cut_at(at, ends)], pa.binary()) for c, x in (("customers", customers), ("counts", counts))}
            | {"shared": pa.array([_bytes(tables[i]) for i in cut_at(of, np.cumsum(each))], pa.binary())}
            | {"sums": pa.array([_bytes(sums[:, i].ravel()) for i in place], pa.binary())}
        )

    def score(group: pa.Table, known: pa.Table) -> pa.Table:
        part, words, ends, text, row_ends = part_of(group, 1)
        known = known.sort_by("owner")
        counts, customers = _all(known, "counts", np.int64), _all(known, "customers", np.int64)
        vocabulary, root_total = pc.sum(known["vocabulary"]).as_py(), pc.sum(known["total"]).as_py()
        p_root = (customers + config.root_mass) / (root_total + config.root_mass * (vocabulary + 1))
        parent, shared = p_root[part.dish_word], part.shared_dishes(np.searchsorted(ends, np.arange(len(words)), side="right"))
        if len(shared):
            sums = np.sum(_rows(known, "sums", np.int64), axis=0).reshape(4, -1)
            parent[shared] = whole_context(_all(known, "shared", np.int64), parent[shared], *sums[:, np.searchsorted(part.families, part.dish_family[shared])])
        p = np.zeros(len(part.count))
        for step in range(config.burn_in + config.samples):
            part.sweep(parent)
            if step >= config.burn_in:
                p += part.predictive(parent) / config.samples
        base = np.log10((counts + 0.5) / (n_train + 0.5 * (vocabulary + 1)))
        log_p, seen, columns = np.log10(p), counts > 0, {c: [] for c in ("text", "known", "base", "score")}
        for a, b in zip([0, *row_ends[:-1].tolist()], row_ends.tolist(), strict=True):  # a row at a time, so nothing more of a token's width is made for all
            of = part.type_of[a:b]
            texts, at = np.unique(text[a:b], return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(texts)) for x in (seen[part.word[of]], base[part.word[of]], log_p[of])]
            for c, x in zip(columns, (texts, sums[0].astype(np.uint32), sums[1], sums[2].astype(np.float32)), strict=True):
                columns[c].append(_bytes(x))
        return pa.table({"batch": group["batch"]} | {c: pa.array(x, pa.binary()) for c, x in columns.items()} | {"ids": group["ids"], "sizes": group["sizes"]})

    def gather(group: pa.Table) -> pa.Table:
        ids, text = group["ids"].combine_chunks().flatten(), _all(group, "text", np.uint16)
        known, base, scored = (np.bincount(text, weights=_all(group, c, k), minlength=len(ids)) for c, k in (("known", np.uint32), ("base", np.float64), ("score", np.float32)))
        return pa.table({"id": ids, "n_tokens": group["sizes"].combine_chunks().flatten(), "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(scored)})

    sent = rows.mapInArrow(tokens, f"part int, batch long, contexts binary, families binary, runs binary, leaf binary, words binary, word binary, text binary, ids array<{kind}>, sizes array<long>")
    seated = sent.groupBy("part").applyInArrow(seat, "owner int, part int, words binary, customers binary, counts binary, held binary, families binary, dishes binary, tables binary")
    told = seated.groupBy("owner").applyInArrow(root, "part int, owner int, vocabulary long, total long, customers binary, counts binary, shared binary, sums binary")  # of each owner a row for each part
    scored = sent.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(score, f"batch long, text binary, known binary, base binary, score binary, ids array<{kind}>, sizes array<long>")
    out = scored.groupBy("batch").applyInArrow(gather, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def pair_of(before: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + second)


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: perplexity (10 to the mean negative log10 probability of a token) of all rows of model_scores, and of the base. Null where there are no rows."""
    tokens = F.sum("n_tokens")
    return scores.agg(F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"))
