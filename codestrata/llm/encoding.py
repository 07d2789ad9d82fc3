"""Garbled text from wrong character encodings, found and repaired by expectation-maximization.

A latent chain stands behind each place of a text: nothing went wrong, or bytes of one encoding were decoded with another, once
or repeatedly. Which chains occur, and how often, is learned for each source and field, and so is a character model of correct text: the
E-step weighs, for every distinct word with characters beyond ASCII, what the word would be if undone along each
chain; the M-step adds up the weights into chain rates for each source and into the character model. Evidence too weak in
one record is thus pooled over all records of its source. A record is then judged, and repaired, by posterior.

The rates by source stay a table that is joined to the words and texts; only the character model and the rates of all sources together come to the driver.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codestrata.tables import materialize, spread

_CONTROL = re.compile("[\x80-\x9f]")
INTACT = "intact"
LOST = "lost"  # replacement characters: garbled, and the original bytes are gone
TOLERANCE = 1e-3  # relative gain in log likelihood at which the rounds end
MOST_ROUNDS = 50  # beyond which something is wrong
LEAST_POSTERIOR = 1e-4  # of what a word may have been; less is shared out among the rest
PLACE_RATE = 0.5  # of a record garbled along a chain, the share of words expected to show it
VOTE = 3.0
SMOOTH = 20.0
UNSEEN = 0.01
PRIOR_WEIGHT = 50.0  # how many words of all sources back up one source's chain rates
SURE = math.log(3.0)  # posterior odds from which a record counts as garbled

# Code pages by how text comes to be decoded with them, and the encodings the bytes really had.
BYTE_PAGES = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "cp1254", "iso8859_2")
WIDE_PAGES = ("gbk", "cp932", "big5", "cp949")
SWAPS = (
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp866", "koi8_r"), ("koi8_r", "cp866"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("cp1252", "cp866"), ("mac_roman", "cp1251"),
    ("cp1252", "cp1250"), ("latin-1", "cp1250"), ("latin-1", "iso8859_2"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"),
    ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("cp1252", "cp437"),
    ("latin-1", "cp437"), ("cp1252", "cp850"), ("latin-1", "cp850"), ("cp1252", "gbk"), ("latin-1", "gbk"), ("cp437", "gbk"), ("cp1252", "big5"),
    ("cp1252", "cp932"), ("cp866", "cp1252"), ("koi8_r", "cp1252"), ("cp1251", "cp1250"), ("cp437", "cp1250"), ("cp850", "cp1250"),
)
THRICE = ("cp1252", "latin-1")
MIXED = (("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1250", "cp1252"))  # swapped first, then UTF-8 read as cp1252
TWICE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")


@functools.cache
def _page(name: str) -> dict[str, int]:
    """The byte of each character beyond ASCII. Bytes that cp125x leave open stand for the control character, as browsers read them."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            if name.startswith("cp125"):
                out[chr(b)] = b
    return out


@functools.cache
def _undo_utf8(page: str) -> Callable[[str], str | None]:
    """Undo UTF-8 decoded with a single-byte page, wherever characters stand for a valid UTF-8 sequence."""
    of = _page(page)
    group = lambda lo, hi: "[" + re.escape("".join(c for c, b in of.items() if lo <= b <= hi)) + "]"
    tail = group(0x80, 0xBF)
    pattern = re.compile(f"(?:{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}})+")

    def fix(m: re.Match) -> str:
        try:
            return bytes(of[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    leads = frozenset(c for c, b in of.items() if 0xC2 <= b <= 0xF4)

    def undo(word: str) -> str | None:
        if leads.isdisjoint(word):
            return None
        out = pattern.sub(fix, word)
        return out if out != word else None

    return undo


@functools.cache
def _undo_wide(page: str) -> Callable[[str], str | None]:
    """Undo UTF-8 decoded with a multi-byte page, run by run; a run's torn last character is lost. Such text always holds ideographs or kana."""
    def undo(word: str) -> str | None:
        if max(word) < "\u2e80":
            return None

        def fix(m: re.Match) -> str:
            try:
                raw = m.group().encode(page)
                return raw.decode("utf-8")
            except UnicodeEncodeError:
                return m.group()
            except UnicodeDecodeError as e:
                good = raw.decode("utf-8", "ignore")
                return good if e.start and 3 * len(good) >= len(raw) * 0.75 else m.group()

        out = re.sub(r"[^\x00-\x7f�]+", fix, word)
        return out if out != word else None

    return undo


@functools.cache
def _on_page(page: str) -> frozenset[str]:
    return frozenset(_page(page)) | frozenset(map(chr, range(128)))


def _raw(word: str, page: str) -> bytes | None:
    """The bytes of a word on a page, or None if a character is not on it."""
    if not _on_page(page).issuperset(word):
        return None
    try:
        return word.encode(page)
    except UnicodeEncodeError:
        if not page.startswith("cp125") or not _CONTROL.search(word):
            return None
    of = _page(page)
    try:
        return bytes(of[c] if c > "\x7f" else ord(c) for c in word)
    except KeyError:
        return None


@functools.cache
def _undo_swap(page: str, true: str) -> Callable[[str], str | None]:
    """Undo one page read as another. Characters of the word that are not on the page make it infeasible."""
    def undo(word: str) -> str | None:
        raw = _raw(word, page)
        try:
            out = raw.decode(true) if raw is not None else word
        except UnicodeDecodeError:
            return None
        return out if out != word else None

    return undo


@functools.cache
def _swaps_by_page() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for page, true in SWAPS:
        out[page].append((f"{true}>{page}", true))
    return out


def _then(first: Callable, second: Callable) -> Callable[[str], str | None]:
    def undo(word: str) -> str | None:
        half = first(word)
        return None if half is None else second(half)

    return undo


def _before(page: str) -> tuple[str, ...]:
    """The pages that a text garbled along UTF-8 may have been read with before it was read with ``page``."""
    return TWICE if page in THRICE else THRICE


@functools.cache
def chains() -> dict[str, Callable[[str], str | None]]:
    """Each chain's name and the function that undoes it, or gives None where the word can't have come that way."""
    once = {f"utf-8>{p}": _undo_utf8(p) for p in BYTE_PAGES} | {f"utf-8>{p}": _undo_wide(p) for p in WIDE_PAGES}
    out = dict(once)
    out |= {f"{t}>{p}": _undo_swap(p, t) for p, t in SWAPS}
    for a in TWICE:
        for b in _before(a):
            out[f"utf-8>{b}, utf-8>{a}"] = _then(_undo_utf8(a), _undo_utf8(b))
    for a in THRICE:
        out[f"utf-8>{a} three times"] = _then(_then(_undo_utf8(a), _undo_utf8(a)), _undo_utf8(a))
    for t, p in MIXED:
        out[f"{t}>{p}, utf-8>cp1252"] = _then(_undo_utf8("cp1252"), _undo_swap(p, t))
    return out


@functools.cache
def _class(c: str) -> str:
    """The symbol that stands for a character in the pair counts; those of large scripts share one."""
    if c < "\x80":
        return c if c.isalpha() else "0" if c.isdigit() else "."
    n = ord(c)
    if n >= 0x2E80:
        return "一" if 0x3400 <= n <= 0x9FFF else "あ" if n < 0x3400 else "가" if n < 0xE000 else "Ａ" if 0xFF00 <= n < 0xFFF0 else "\ue000"
    return c


class _Steps(dict):
    """The log probability of each pair of characters, worked out when first asked for."""

    def __init__(self, model: "CharacterModel"):
        self.model = model

    def __missing__(self, pair: str) -> float:
        got = self[pair] = self.model.step(pair[0], pair[1])
        return got

    def __reduce__(self):
        return _Steps, (self.model,)


class CharacterModel:
    """Pair probabilities of characters in words, smoothed by single ones; counts as collected by the M-step."""

    def __init__(self, counts: dict[str, float]):
        self.pair = {k: v for k, v in counts.items() if len(k) == 2}
        self.one = {k[2]: v for k, v in counts.items() if k.startswith("#1")}
        self.first: dict[str, float] = defaultdict(float)
        self.single: dict[str, float] = defaultdict(float)
        for k, v in self.pair.items():
            self.first[k[0]] += v
            self.single[k[1]] += v
        self.total = sum(self.single.values()) + UNSEEN * 3000
        self.wide: dict[str, float] = defaultdict(float)
        for c, v in self.one.items():
            self.wide[_class(c)] += v
        self.seen = frozenset(map(chr, range(128))) | {c for c, v in self.single.items() if v > 0 and _class(c) == c} | {c for c, v in self.one.items() if v > 0}
        self.steps = _Steps(self)

    def knows(self, word: str) -> bool:
        """Whether each character was seen in correct text."""
        return self.seen.issuperset(word)

    def step(self, a: str, b: str) -> float:
        x, y = _class(a), _class(b)
        back = (self.single.get(y, 0.0) + UNSEEN) / self.total
        got = math.log((self.pair.get(x + y, 0.0) + SMOOTH * back) / (self.first.get(x, 0.0) + SMOOTH))
        if y != b and b > "\x7f":
            got += math.log((self.one.get(b, 0.0) + UNSEEN) / (self.wide.get(y, 0.0) + UNSEEN * 20000))
        return got

    def score(self, word: str) -> float:
        return sum(map(self.steps.__getitem__, map(operator.add, " " + word, word + " ")))


def _count_word(word: str, weight: float, into: dict[str, float]) -> None:
    last = "."
    for c in word:
        k = _class(c)
        into[last + k] += weight
        if k != c and c > "\x7f":
            into["#1" + c] += weight
        last = k
    into[last + "."] += weight


def words(text: str | None) -> list[str]:
    """Words, between ASCII blanks, that hold a character beyond ASCII."""
    if not text or text.isascii():
        return []
    return [w for w in re.split(r"[ \t\r\n]+", text) if not w.isascii()]


_MARKS = "\"'`“”‘’„«»()[]<>.,;:!?"
_ABOUT = re.compile(r"encod|charset|code ?page|mojibake|garbl|utf-?8|latin|cp-?125|unicode|decod|terminal|display|kodier|zeichensatz|encodage|codific", re.I)
_LINE = re.compile(r"[^\n]+")


def quoted(text: str) -> set[str]:
    """Words that a text only shows as examples of garbling.

    An example stands alone between blanks or quotation marks, no letter beside it, and its line says so: the line speaks of encodings
    or of display, and either the example is in quotation marks or its restored characters stand alone there as well.
    """
    found: set[str] = set()
    for line in _LINE.findall(text):
        if line.isascii():
            continue
        parts = words(line)
        bare = {w.strip(_MARKS) for w in parts}
        if not _ABOUT.search(line):
            continue
        for w in parts:
            core = w.strip("\"'`“”()[].,;:!?") or w
            if any(c.isascii() for c in core):
                continue
            marked = w[0] in "\"'`“(«" and len(w) > len(core)
            outs = {o for _, o in _utf8_options(core)}
            if (core == "�" and marked) or (outs and (marked or outs & bare)):
                found.add(w)
    return found


def _utf8_options(word: str) -> list[tuple[str, str]]:
    """(chain, restored word) of the chains that began as UTF-8. What undoes a chain's last step is worked out once for all chains that share it."""
    got = []
    for page in BYTE_PAGES:
        half = _undo_utf8(page)(word)
        if half is None:
            continue
        got.append((f"utf-8>{page}", half))
        if page in TWICE:
            got += [(f"utf-8>{b}, utf-8>{page}", out) for b in _before(page) if (out := _undo_utf8(b)(half)) is not None]
        if page in THRICE and (out := chains()[f"utf-8>{page} three times"](word)) is not None:
            got.append((f"utf-8>{page} three times", out))
        if page == "cp1252":
            got += [(f"{t}>{p}, utf-8>cp1252", out) for t, p in MIXED if (out := _undo_swap(p, t)(half)) is not None]
    return got + [(f"utf-8>{p}", out) for p in WIDE_PAGES if (out := _undo_wide(p)(word)) is not None]


def _options(word: str, known: Callable[[str], bool] | None = None) -> dict[str, list[str]]:
    """Each word this one may have been, with the chains that lead from it to here.

    With ``known``, a swap of pages that gives a letter never seen in correct text is no option; its probability would be as good as nothing.
    """
    got: dict[str, list[str]] = {}
    control = bool(_CONTROL.search(word))
    for name, out in _utf8_options(word):
        if control or not _CONTROL.search(out):
            got.setdefault(out, []).append(name)
    for page, swaps in _swaps_by_page().items():
        raw = _raw(word, page)
        if raw is None:
            continue
        for name, true in swaps:
            try:
                out = raw.decode(true)
            except UnicodeDecodeError:
                continue
            if out != word and (known is None or known(out)) and (control or not _CONTROL.search(out)):
                got.setdefault(out, []).append(name)
    return got


def _scored(word: str, model: "CharacterModel") -> tuple[float, list[tuple[list[str], str, float]]]:
    """The log probability of the word as it is, and (chains, restored, log probability) of its options."""
    options = _options(word, model.knows)
    return (model.score(word), [(c, r, model.score(r)) for r, c in options.items()]) if options else (0.0, [])


class Beliefs:
    """What the M-step hands to the next E-step: the character model and the rates of chains over all sources. Those of one source come with its rows."""

    def __init__(self, counts: dict[str, float], rates: dict[str, float]):
        self.model = CharacterModel(counts)
        every = sum(rates.values()) or 1.0
        names = [INTACT, *chains()]
        self.started = bool(rates)
        self.shared = {c: (rates.get(c, 0.0) + 0.5) / (every + 0.5 * len(names)) for c in names}
        self.log_rates = functools.lru_cache(10_000)(self._log_rates)

    def _log_rates(self, rates: str | None) -> dict[str, float]:
        own = json.loads(rates) if rates else {}
        total = math.log(sum(own.values()) + PRIOR_WEIGHT)
        return {c: math.log(own.get(c, 0.0) + PRIOR_WEIGHT * x) - total for c, x in self.shared.items()}

    def __reduce__(self):
        return _beliefs, (self.model, self.shared, self.started)


def _beliefs(model: CharacterModel, shared: dict[str, float], started: bool) -> Beliefs:
    out = Beliefs.__new__(Beliefs)
    out.model, out.shared, out.started = model, shared, started
    out.log_rates = functools.lru_cache(10_000)(out._log_rates)
    return out


def _weights(rates: str | None, word: str, beliefs: Beliefs | None) -> tuple[list[tuple[str, str, float]], float]:
    """(chain, restored, posterior) of one word, with 'intact' among the chains, and the word's log likelihood. ``rates`` are its source's."""
    if beliefs is None:
        return [(INTACT, word, 1.0)], 0.0
    if not beliefs.started:  # to begin with: valid UTF-8 of known characters hidden in a word is no accident
        utf8 = [(c, r) for c, r in _utf8_options(word) if len(r) < len(word) and beliefs.model.knows(r)]
        return [(*min(utf8, key=lambda x: len(x[1])), 1.0)] if utf8 else [(INTACT, word, 1.0)], 0.0
    base, options = _scored(word, beliefs.model)
    if not options:
        return [(INTACT, word, 1.0)], 0.0
    rate = beliefs.log_rates(rates)
    logs = [(INTACT, word, rate[INTACT] + base)]
    for names, r, x in options:  # of chains that give the same word the likeliest here
        best, c = max((rate[c], c) for c in names)
        logs.append((c, r, best + x))
    top = max(x[2] for x in logs)
    raw = [(c, r, math.exp(x - top)) for c, r, x in logs]
    total = sum(x[2] for x in raw)
    kept = [x for x in raw if x[2] > LEAST_POSTERIOR * total]
    mass = sum(x[2] for x in kept)
    return [(c, r, x / mass) for c, r, x in kept], top + math.log(total)


def _count_words(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in rows:
        n: Counter = Counter()
        for source, text in zip(b["source"], b["text"]):
            for w in words(text):
                n[source, w] += 1
        yield pd.DataFrame([(s, w, k) for (s, w), k in n.items()], columns=["source", "word", "n"])


def _e_step(rows: Iterator[pd.DataFrame], beliefs: Beliefs | None) -> Iterator[pd.DataFrame]:
    """Expected counts of each batch: chain rates by source, character pairs, and the log likelihood."""
    for b in rows:
        rates: dict[tuple[str, str], float] = defaultdict(float)
        counts: dict[str, float] = defaultdict(float)
        likelihood = 0.0
        for source, word, n, own in zip(b["source"], b["word"], b["n"], b["rates"]):
            found, x = _weights(own, word, beliefs)
            likelihood += x * n
            for chain, restored, p in found:
                rates[source, chain] += p * n
                _count_word(restored, p * n, counts)
        yield pd.DataFrame([("rate", s, c, n) for (s, c), n in rates.items()] + [("pair", "", k, n) for k, n in counts.items()] + [("likelihood", "", "", likelihood)],
                           columns=["what", "source", "key", "n"])


def learn(texts: DataFrame) -> tuple[Beliefs, DataFrame]:
    """Fit chain rates and character model to ``texts(source, text)``, all of them: the beliefs, and (source, rates) with each source's rates as JSON.

    What comes to the driver is bounded by alphabets and chains, whatever the number of texts and sources: pairs of characters of small scripts, single characters
    of large ones, and the rates of all sources together. Words and rates by source stay tables. The rounds end when the log likelihood gains less than TOLERANCE.
    """
    spark = texts.sparkSession
    counted = materialize(
        texts.mapInPandas(_count_words, "source string, word string, n long").groupBy("source", "word").agg(F.sum("n").alias("n")), "words")
    counted = spread(counted, 1)
    beliefs, rates, before = None, None, None
    for rnd in range(MOST_ROUNDS):
        sent = spark.sparkContext.broadcast(beliefs)
        rows = counted.withColumn("rates", F.lit(None).cast("string")) if rates is None else counted.join(rates, "source", "left")
        stats = materialize(
            rows.mapInPandas(lambda b, s=sent: _e_step(b, s.value), "what string, source string, key string, n double")
            .groupBy("what", "source", "key").agg(F.sum("n").alias("n")), "expected")
        all_ = {(r["what"], r["key"]): r["n"] for r in stats.groupBy("what", "key").agg(F.sum("n").alias("n")).collect()}  # alphabets and chains
        likelihood = all_.get(("likelihood", ""), 0.0)
        counts = {key: n for (what, key), n in all_.items() if what == "pair"}
        beliefs = Beliefs(counts, {key: n for (what, key), n in all_.items() if what == "rate"} if rnd else {})
        if rnd:  # the first round only counts characters
            rates = stats.where("what = 'rate'").groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "n")))).alias("rates"))
        if rnd > 1:
            if before is not None and likelihood - before <= TOLERANCE * abs(before):
                break
            before = likelihood
    else:
        raise RuntimeError(f"the rates did not settle within {MOST_ROUNDS} rounds")
    return beliefs, rates


def places(evidence: list[float], need: float) -> list[tuple[int, int, float]]:
    """(first, last, sum) of the stretches whose evidence adds up to more than ``need``: each from where the sum rises from 0 to its peak, until it falls by ``need`` again."""
    found = []
    start = end = 0
    total = peak = 0.0
    for at, e in enumerate(evidence):
        total += e
        if total > peak:
            peak, end = total, at
        elif total <= 0 or peak - total >= need:
            if peak > need:
                found.append((start, end, peak))
            start, total, peak = at + 1, 0.0, 0.0
    return [*found, (start, end, peak)] if peak > need else found


def judge(text: str | None, rates: str | None, beliefs: Beliefs, memo: dict) -> tuple[str, float, str] | None:
    """(chain, log odds, restored text) if the record is garbled, else None. ``rates`` are its source's; ``memo`` keeps what words were found to be under these beliefs.

    For each chain the evidence of all words is added up, each word being a mixture of garbled and intact. A chain also counts if the evidence of
    one stretch of words is enough, wherever it starts, so that a garbled place shows in a text that is correct elsewhere; then only such
    stretches are repaired along it. Words that are only quoted give no evidence and stay as they are.
    """
    found = words(text)
    if not found:
        return None
    skip: set[str] | None = None
    totals: dict[str, float] = defaultdict(float)
    rises: dict[str, float] = defaultdict(float)
    fixes: dict[str, tuple[list[tuple[list[str], str, float]], list[tuple[str, float]]]] = {}
    lost = False
    for w in found:
        if "�" in w:
            skip = quoted(text) if skip is None else skip
            lost = lost or w not in skip
        got = fixes.get(w)
        if got is None:
            got = memo.get(w)
            if got is None:
                base, options = _scored(w, beliefs.model)
                gains = [(c, r, x - base) for c, r, x in options]
                got = gains, [(c, math.log(1 - PLACE_RATE + PLACE_RATE * math.exp(min(gain, 500.0)))) for names, _, gain in gains for c in names]
                if len(memo) > 200_000:
                    memo.clear()
                memo[w] = got
            if any(x[2] > 0 for x in got[0]):
                skip = quoted(text) if skip is None else skip
                if w in skip:
                    got = [], []
            fixes[w] = got
        for c, evidence in got[1]:
            totals[c] += evidence
            if evidence > 0:
                rises[c] += evidence
    own = beliefs.log_rates(rates)
    rate = {c: own[c] - own[INTACT] for c in totals}
    odds = {c: t + rate[c] for c, t in totals.items()}
    whole = {c for c, x in odds.items() if x > SURE}
    # A stretch may start at any word, which its odds have to make up for.
    anywhere = math.log(len(found))
    local: dict[str, list[tuple[int, int, float]]] = {}
    for c, up in rises.items():
        need = SURE + anywhere - rate[c]
        if c not in whole and up > need and (spans := places([dict(fixes[w][1]).get(c, 0.0) for w in found], need)):
            local[c] = spans
            odds[c] = max(x for _, _, x in spans) + rate[c] - anywhere
    sure = whole | local.keys()
    if not sure and not lost:
        return None
    best = max(sure, key=odds.get) if sure else LOST
    able = {w: x for w, (got, _) in fixes.items() if (x := [(c, r, gain) for names, r, gain in got if gain > 0 for c in names if c in sure])}
    votes = Counter(max(x, key=lambda o: (o[2], odds[o[0]]))[0] for x in able.values())
    # A word goes by its own evidence and by how many words of the record each chain explains best.
    ranked = {w: sorted(x, key=lambda o: (o[2] + VOTE * math.log(votes[o[0]] + 0.5), odds[o[0]]), reverse=True) for w, x in able.items()}
    nth = itertools.count()

    def repaired(m: re.Match) -> str:
        w = m.group()
        if w.isascii():
            return w
        at = next(nth)
        return next((r for c, r, _ in ranked.get(w, ()) if c in whole or any(a <= at <= b for a, b, _ in local[c])), w)

    restored = re.sub(r"[^ \t\r\n]+", repaired, text) if ranked else text
    return best, odds.get(best, 0.0), restored


def garbled(documents: DataFrame, key: str = "doc_id", field: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, chain, log_odds, restored) of each record whose field is garbled, wholly or in places.

    Null and empty texts, and those in ASCII, are never garbled. Records without a source are pooled together. ``restored`` repairs
    what can be repaired; where the chain is 'lost', replacement characters remain. Rows with the same key are judged each.
    """
    texts = spread(documents.select(F.col(key).alias("doc_id"), F.col(field).alias("text"), F.coalesce(F.col(source), F.lit("")).alias("source"))
                   .where(F.col("text").rlike(r"[^\x00-\x7F]")))
    learned, rates = learn(texts)
    beliefs = texts.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            got = [judge(text, own, beliefs.value, memo) for text, own in zip(b.column("text").to_pylist(), b.column("rates").to_pylist())]
            hit = [g for g in got if g]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").filter(pa.array([g is not None for g in got], pa.bool_())), *(pa.array([g[i] for g in hit], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string())))],
                ["doc_id", "chain", "log_odds", "restored"])

    return texts.join(rates, "source", "left").select("doc_id", "text", "rates").mapInArrow(run, "doc_id long, chain string, log_odds double, restored string")
