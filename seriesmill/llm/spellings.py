"""Spelling variants: words of a vocabulary that differ by one code point, found by search schemes over bidirectional FM-indexes.

The vocabulary is counted by DataFrame functions. Two near words agree in one half of either: with the error in the
second half, the first half stands unchanged, and the other way round. So each word is indexed twice, in a block dealt by
its length and the start it shares with near words, and in one dealt by its end; it is sought in the blocks of its own
length (for a replaced code point), of one more (inserted) and of one less (deleted). A block's words form one text,
``$word$word$...``, with the rank tables of the text and of its reverse. A search matches the delimiter and one half
exactly in one direction, turns, and extends across the other half in the other direction with exactly one error, keeping
the suffix-rank intervals of both texts in step. All searches of a block go forward together in numpy.

Starts or ends that many words have are dealt on to several blocks, each of which all the searches of that key visit.

Defined cases: null and empty texts have no runs; a null doc_id is the empty string in the checksum; repeated rows
count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settle

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest words and fewest occurrences; each TYPO-th checksum takes a code point out; times that a form is as frequent.
LEAST, SEEN, TYPO, TIMES = 6, 5, 199, 5
#: Symbols of a block's text, and words of one start or end that stay in one block (on vocabularies of over KEYS times as many
#: words it grows with them, so that the list of such keys can be broadcast).
SYMBOLS, HOT, KEYS = 60_000, 4_000, 100_000
#: Bytes of a rank table; longer texts keep every second, fourth ... row.
TABLE = 32 << 20
#: What a word is sought for: a word of its own length, of one more, of one less.
REPLACED, INSERTED, DELETED = 0, 1, 2


# --- the index ---
def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the text's suffixes in their order, by doubling; its last symbol stands nowhere else."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        next_ = np.zeros(n, np.int64)
        next_[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + next_
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        if fresh[order[-1]] == n - 1:
            return order
        rank, k = fresh, 2 * k


class Ranks:
    """For a last column: how many symbols smaller than c stand before place i."""

    def __init__(self, column: np.ndarray, symbols: int):
        self.column, n = column, len(column)
        self.step = 1
        while 4 * (symbols + 1) * (n // self.step + 1) > TABLE:
            self.step *= 2
        self.symbols = np.arange(symbols + 1)
        self.table = np.zeros((n // self.step + 1, symbols + 1), np.int32)
        for c in range(1, symbols + 1):
            self.table[:, c] = np.concatenate([[0], np.cumsum(column < c)])[:: self.step]

    def rows(self, i: np.ndarray) -> np.ndarray:
        """Of all symbols, for each place."""
        at = i // self.step
        out = self.table[at]
        for d in range(self.step - 1):
            some = np.flatnonzero(i - at * self.step > d)
            out[some] += self.column[at[some] * self.step + d][:, None] < self.symbols
        return out

    def pair(self, c: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of c and of the symbol after it."""
        at = i // self.step
        low, high = self.table[at, c].astype(np.int64), self.table[at, c + 1].astype(np.int64)
        for d in range(self.step - 1):
            some = np.flatnonzero(i - at * self.step > d)
            symbol = self.column[at[some] * self.step + d]
            low[some] += symbol < c[some]
            high[some] += symbol <= c[some]
        return low, high


class BiIndex:
    """A text with a unique smallest last symbol (0), and its reverse. An interval is (start among the text's suffixes, start among
    the reverse's, size); ``ahead`` says whether a pattern grows at its end or at its start."""

    def __init__(self, text: np.ndarray, symbols: int):
        back = np.concatenate([text[:-1][::-1], text[-1:]])
        self.order, other = suffix_order(text), suffix_order(back)
        self.ranks = {False: Ranks(text[self.order - 1], symbols), True: Ranks(back[other - 1], symbols)}
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.order))

    def grow(self, at: tuple, c: np.ndarray, ahead: bool) -> tuple:
        """Each interval's pattern with one symbol more."""
        own, other, size = (at[1], at[0], at[2]) if ahead else at
        low, high = self.ranks[ahead].pair(c, own)
        low_end, high_end = self.ranks[ahead].pair(c, own + size)
        own, other, size = self.begin[c] + high - low, other + low_end - low, high_end - low_end - high + low
        return (other, own, size) if ahead else (own, other, size)

    def fan(self, at: tuple, first: int, ahead: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Each interval with every symbol from ``first`` on: (interval, symbol, what it becomes), none empty."""
        own, other, size = (at[1], at[0], at[2]) if ahead else at
        low, end = self.ranks[ahead].rows(own), self.ranks[ahead].rows(own + size)
        smaller = end - low
        sizes = smaller[:, 1:] - smaller[:, :-1]
        sizes[:, :first] = 0
        k, c = np.nonzero(sizes)
        own, other, size = self.begin[c] + low[k, c + 1] - low[k, c], other[k] + smaller[k, c], sizes[k, c].astype(np.int64)
        return k, c, (other, own, size) if ahead else (own, other, size)


DELIMITER, LETTER = 1, 2


class Words:
    """An index of distinct words."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = np.frombuffer("$".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # of the delimiter before each
        letter = np.ones(len(codes), bool)
        letter[np.append(self.at, len(codes) - 1)] = False
        self.alphabet, place = np.unique(codes[letter], return_inverse=True)
        text = np.full(len(codes) + 1, DELIMITER)
        text[:-1][letter] = place + LETTER
        text[-1] = 0
        self.symbols = len(self.alphabet) + LETTER
        self.index = BiIndex(text, self.symbols)

    def near(self, sought: list[str], kind: np.ndarray, first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``sought``, place in ``words``) of words that differ from a sought one by one error of its ``kind``, with its
        first (second) half standing exactly at their start (end). Each pair once."""
        codes = np.frombuffer("".join(sought).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == codes if len(self.alphabet) else np.zeros(len(codes), bool)
        codes = np.where(known, at + LETTER, -1)  # a letter that no word has
        size = np.fromiter(map(len, sought), np.int64, len(sought))
        start, half = np.cumsum(size) - size, size // 2
        held = np.fromiter(map(set(self.words).__contains__, sought), np.int64, len(sought))
        ahead = first_half  # the way in which the half with the error is read
        exact, rest = (half, size - half) if first_half else (size - half, half)

        def letter(q: np.ndarray, j: np.ndarray, part: str) -> np.ndarray:
            """The j-th symbol from the middle outwards of one part; the delimiter behind its last."""
            outwards_right = (part == "rest") == first_half
            n = (rest if part == "rest" else exact)[q]
            where = start[q] + half[q] + np.where(outwards_right, j, -1 - j)
            return np.where(j < n, codes[np.where(j < n, where, 0)], DELIMITER)

        def step(q, at, c, ahead):
            good = (c >= 0) & (at[2] > 0)
            at = self.index.grow(tuple(x[good] for x in at), c[good], ahead)
            alive = at[2] > 0
            kept = np.flatnonzero(good)[alive]
            return kept, q[kept], tuple(x[alive] for x in at)

        # the exact half and its delimiter, from the middle outwards
        q, at, found, j = np.arange(len(sought)), self.index.whole(len(sought)), [], 0
        ready: list[tuple] = []
        while len(q):
            _, q, at = step(q, at, letter(q, np.full(len(q), j), "exact"), not ahead)
            over = j == exact[q]
            ready.append((q[over], tuple(x[over] for x in at)))
            q, at, j = q[~over], tuple(x[~over] for x in at), j + 1
        q, at = np.concatenate([x[0] for x in ready] or [q]), tuple(np.concatenate([x[1][k] for x in ready] or [at[k]]) for k in range(3))
        # then the other way: searches without an error so far stand at one symbol, those with one anywhere
        j, wrong = 0, (np.zeros(0, np.int64), np.zeros(0, np.int64), self.index.whole(0))
        while len(q) or len(wrong[0]):
            own, new = kind[q], []
            here = letter(q, np.full(len(q), j), "rest")
            # where the only word with this part is oneself, nothing can be replaced
            inside = (own == REPLACED) & (j < rest[q]) & (at[2] > held[q]) | (own == INSERTED)
            if inside.any():
                k = np.flatnonzero(inside)
                of, c, to = self.index.fan(tuple(x[k] for x in at), LETTER, ahead)
                k = k[of]
                # an inserted letter that equals the next one counts behind it
                good = c != here[k]
                k, to = k[good], tuple(x[good] for x in to)
                new.append((q[k], j + (own[k] == REPLACED), to))
            gone = np.flatnonzero((own == DELETED) & (j < rest[q]))
            if len(gone):  # of equal letters side by side the last one
                gone = gone[here[gone] != letter(q[gone], np.full(len(gone), j + 1), "rest")]
                new.append((q[gone], np.full(len(gone), j + 1), tuple(x[gone] for x in at)))
            wrong = tuple(np.concatenate([x[k] for x in [wrong, *new]]) for k in range(2)) + (tuple(np.concatenate([x[2][k] for x in [wrong, *new]]) for k in range(3)),)
            more = j < rest[q]
            _, q, at = step(q[more], tuple(x[more] for x in at), here[more], ahead)
            j += 1
            kept, wq, wat = step(wrong[0], wrong[2], letter(wrong[0], wrong[1], "rest"), ahead)
            wj = wrong[1][kept]
            over = wj == rest[wq]
            found.append((wq[over], wat[0][over]))
            wrong = (wq[~over], wj[~over] + 1, tuple(x[~over] for x in wat))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, place = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        return q, np.searchsorted(self.at, self.index.order[place])


# --- on Spark ---
def vocabulary(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, n: runs of letters, some with a code point taken out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).filter(F.length("run") >= LEAST)
    h = low.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    typo = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % TYPO == 0, typo).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN)


def _shared(size: Column, first_half: bool) -> Column:
    """How much of its start (end) a word of this size shares with any word that is sought among such words."""
    return F.greatest(F.lit(LEAST // 2), F.floor((size - 1) / 2)) if first_half else F.greatest(F.lit(LEAST - LEAST // 2), F.floor(size / 2))


def _key(size: Column, first_half: bool) -> Column:
    n = _shared(size, first_half).cast("int")
    part = F.substring("word", F.lit(1), n) if first_half else F.substring("word", F.length("word") - n + 1, n)
    return F.xxhash64(F.lit(first_half), size, part)


def near_pairs(words: DataFrame) -> DataFrame:
    """words (word, n), distinct, of LEAST code points or more -> word, near, near_n: each ordered pair of words that differ by one
    code point."""
    total = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)), F.count(F.lit(1))).first()
    blocks, hot = max(1, -(-total[0] // SYMBOLS)), max(HOT, -(-total[1] // KEYS))
    own = F.length("word")
    kept = [words.select(F.lit(first).alias("first_half"), _key(own, first).alias("key"), F.lit(None).cast("int").alias("kind"), "word", "n") for first in (True, False)]
    other = {REPLACED: own, INSERTED: own + 1, DELETED: own - 1}
    sought = [words.select(F.lit(first).alias("first_half"), _key(size, first).alias("key"), F.lit(kind).alias("kind"), "word", "n") for first in (True, False) for kind, size in other.items()]
    kept, sought = kept[0].union(kept[1]), sought[0].union(sought[1]).union(sought[2]).union(sought[3]).union(sought[4]).union(sought[5])
    many = settle(kept.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot).select("key", F.ceil(F.col("rows") / hot).cast("int").alias("copies")), "spelling-hot")
    copies = F.coalesce("copies", F.lit(1))
    dealt = kept.join(F.broadcast(many), "key", "left").withColumn("part", F.pmod(F.xxhash64("word"), copies).cast("int"))
    spread = sought.join(F.broadcast(many), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), copies - 1)))
    block = F.pmod(F.xxhash64("key", "part"), F.lit(blocks))
    rows = dealt.union(spread).select("first_half", block.alias("block"), "kind", "word", "n")

    def search(of: pd.DataFrame) -> pd.DataFrame:
        index, out = of[of["kind"].isna()], []
        if len(index):
            words, first_half = Words(index["word"].tolist()), bool(of["first_half"].iloc[0])
            n = index["n"].to_numpy()
            asked = of[of["kind"].notna()].drop_duplicates(["word", "kind"])  # two parts of a key may meet in a block
            size = index["word"].str.len().to_numpy()
            for begin in range(0, len(asked), 20_000):
                some = asked.iloc[begin : begin + 20_000]
                texts, kind = some["word"].tolist(), some["kind"].to_numpy().astype(np.int64)
                q, w = words.near(texts, kind, first_half)
                if not first_half:  # pairs with the same first half are found by it
                    fresh = np.array([texts[a][: len(texts[a]) // 2] != words.words[b][: len(texts[a]) // 2] for a, b in zip(q.tolist(), w.tolist(), strict=True)], bool)
                    q, w = q[fresh], w[fresh]
                assert (size[w] - np.fromiter(map(len, texts), np.int64, len(texts))[q] == np.array([0, 1, -1])[kind[q]]).all()
                out.append(pd.DataFrame({"word": [texts[a] for a in q.tolist()], "near": [words.words[b] for b in w.tolist()], "near_n": n[w]}))
        return pd.concat(out) if out else pd.DataFrame({"word": [], "near": [], "near_n": []})

    return rows.groupBy("first_half", "block").applyInPandas(search, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), form not null, without cycles -> word, root: the end of each word's chain, by doubling steps."""
    at = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        fresh = settle(at.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        forget(at)
        at = fresh.select("word", "root")
        at.settled_path = fresh.settled_path
        if fresh.filter("moved").isEmpty():
            return at


def group(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n."""
    words = settle(vocabulary(docs), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best"))
    found = words.join(best, "word", "left").withColumn("held", held)
    found = settle(found.select("word", F.col("held.near").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("held.less")).alias("form_n")), "spelling-forms")
    forget(words)
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
with recursive table_ as (
  select list(c order by i) as tab from (
    select i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(0, 256)) as i))
), runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents
), low as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs where length(run) >= 6 group by 1, 2
), spelled as (
  select run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end)) as bytes from low
), summed as (
  select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: x::bigint)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) as h from spelled, table_
), typed as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from summed
), v as (
  select word, sum(n)::bigint as n from typed where length(word) >= 6 group by 1 having sum(n) >= 5
), gaps as (
  select word, n, length(word) as size, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)
), near as (
  select distinct a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.size = b.size and a.i = b.i and a.rest = b.rest and a.word <> b.word
  union all select distinct g.word, v.word, v.n from gaps g join v on g.rest = v.word
  union all select distinct v.word, g.word, g.n from gaps g join v on g.rest = v.word
), best as (
  select v.word, v.n, count(near.near) as n_near, arg_min((near.near, near.near_n), (-near.near_n, near.near)) filter (near.near is not null) as b from v left join near on near.word = v.word group by 1, 2
), forms as (
  select word, n, n_near, case when b[2] >= 5 * n then b[1] end as form, case when b[2] >= 5 * n then b[2] end as form_n from best
), chain as (
  select word, word as root from forms
  union all select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null
), ends as (
  select c.word, c.root from chain c join forms f on f.word = c.root where f.form is null
)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n from forms f join ends e using (word)
"""
