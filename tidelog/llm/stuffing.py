"""Keyword-stuffed and link-list pages (problem 8): lines labelled by a hidden Markov model.

Each line of a page is prose, a record (a row of a table or timetable, names), a notice (what else is no spam, such
as adverts), a link list, a tag list (keywords, search phrases, tags, articles) or a menu. What a line shows depends
on its label: the shares of function words, digits, signs, capitals and joined words, words that fill the page, the
shapes of its tokens and its words. What each label shows is learned from labelled pages, as is how labels follow
each other. The most
likely labels of the whole page are found with the Viterbi algorithm; a page is flagged by the share of its
words in lines of the last three kinds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import checkpoint

#: Pages labelled side by side, and the bytes of them (one page at least).
PAGES, PAGE_BYTES = 2000, 4 << 20
PROSE, RECORD, NOTICE, LINKS, TAGS, MENU = range(6)
LABELS = ("prose", "record", "notice", "links", "tags", "menu")

#: Frequent function words of the languages of the pages (en, de, fr, es). Fixed values.
FUNCTION_WORDS = """
the of and to in a an is was that for by on at with he his she her it its as be been were has had have this which who not but or from will so are they their we our said when how if so after before very under no nothing what until
der die das den dem des und ein eine einen einem einer ist war wird wurde werden worden von zu zum zur mit auf aus für im am an als wie nicht noch nach bei sich es er sie dass daß ob aber doch hat haben habe durch über seit man wenn
le la les l d de du des un une et est était été sera à au aux en dans par pour sur que qui ne pas plus n il elle on ce cette son sa ses se a ont avec mais si fut ou
el los las del y e al lo una unos que es fue ser ha sido por para con no se su sus como más pero si cuando desde hacía muy sin este esta había
""".split()

# patterns of RE2, counted by Arrow over all lines of a batch
_W = r"(?:^|[^\p{L}\p{N}])"
_FUNCTION = rf"(?i){_W}(?:{'|'.join(dict.fromkeys(FUNCTION_WORDS))})\b"
_DIGITS = r"\d"
_SIGNS = r"[^\p{L}\p{M}\p{N}\s]"
_CAPITAL = rf"{_W}\p{{Lu}}"
_NUMBER = r"(?:^|[\s(£])\d{1,4}(?:[.,:;)]|\s|$)"
#: The parts of a token's shape, in this order: capitalised and other words, numbers, repeated signs.
_SHAPE = ((r"\p{Lu}[\p{L}\p{M}]*", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}][\p{L}\p{M}]*", "a"), (r"\p{N}+", "9"))
#: Shapes longer than SHAPE_CHARS are told apart by these first ones; shapes are hashed to so many numbers.
SHAPE_CHARS, SHAPES = 8, 1024
#: Words of at least so many letters are hashed to so many numbers.
WORD_CHARS, WORDS = 3, 4096
#: What tokens tell one by one, and its numbers.
SYMBOLS = {"shape": SHAPES, "word": WORDS}


#: A word fills a page if it is one in so many of its longer words, and leads it if it is one in so many.
FILLS, LEADS = 40, 16
_STOP = frozenset(FUNCTION_WORDS)
#: Letters often read for one another in scans, each taken for the first of its group. Fixed values.
MISREAD = ["ceo0", "lit1j", "unü", "hb6", "sſf5", "rvy", "aáàâä"]
_FOLD = {ord(c): g[0] for g in MISREAD for c in g}
_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"))


def _same_as(word: str, known: dict[str, int]) -> int:
    """Number of the word, alike for words that are easily misread for each other; -1 if it is short, a
    function word or a number."""
    if len(word) < 4 or word in _STOP or not any(c.isalpha() for c in word):
        return -1
    for pair, one in _PAIRS:
        word = word.replace(pair, one)
    return known.setdefault(word.translate(_FOLD), len(known))


def _shapes(tokens) -> np.ndarray:
    """Number below SHAPES of each token's shape; -1 for an empty one. Tokens: an Arrow array of strings."""
    import pyarrow.compute as pc

    shape = tokens
    for pattern, one in _SHAPE:
        shape = pc.replace_substring_regex(shape, pattern, one)
    shape = pc.dictionary_encode(pc.utf8_slice_codeunits(shape, 0, SHAPE_CHARS))
    number = np.array([zlib.crc32(x.encode()) % SHAPES if x else -1 for x in shape.dictionary.to_pylist()], dtype=np.int64)
    return number[shape.indices.to_numpy()]


def _words(words: list[str]) -> np.ndarray:
    """Number below WORDS of each word in lower case, alike for those easily misread for each other; -1 if it tells nothing."""
    out = np.full(len(words), -1, dtype=np.int64)
    for i, w in enumerate(words):
        if len(w) >= WORD_CHARS and any(c.isalpha() for c in w):
            for pair, one in _PAIRS:
                w = w.replace(pair, one)
            out[i] = zlib.crc32(w.translate(_FOLD).encode()) % WORDS
    return out


def line_features(texts) -> dict[str, np.ndarray]:
    """Per line of an Arrow array of texts (no nulls): `page` (its number), counts of what it shows, `numbered`: the
    share of the page's lines that have a number, and `filling`, `leading`: the share of its longer words that fill or
    lead the page. Per token: `shape` and `shape_line`, its shape and line."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.split_pattern(texts, "\n")
    page = pc.list_parent_indices(split).to_numpy()
    lines = pc.list_flatten(split)
    out = {"page": page}
    for name, pattern in (("function", _FUNCTION), ("digits", _DIGITS), ("signs", _SIGNS), ("capitals", _CAPITAL), ("numbers", _NUMBER)):
        out[name] = pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(np.int32)
    out["chars"] = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int32)
    tokens = pc.split_pattern_regex(lines, r"\s+")
    line, coded = pc.list_parent_indices(tokens).to_numpy(), pc.dictionary_encode(pc.list_flatten(tokens))
    shape = _shapes(coded.dictionary)[coded.indices.to_numpy()]
    inner = np.asarray(pc.match_substring_regex(coded.dictionary, r"[\p{L}\p{N}][^\p{L}\p{M}\p{N}\s'’-]+[\p{L}\p{N}]"))[coded.indices.to_numpy()]
    out["tokens"] = np.bincount(line[shape >= 0], minlength=len(page)).astype(np.int32)
    out["joined"] = np.bincount(line, weights=inner, minlength=len(page)).astype(np.int32)
    out["shape"], out["shape_line"] = shape[shape >= 0], line[shape >= 0]
    parts = pc.split_pattern_regex(pc.utf8_lower(lines), r"[^\p{L}\p{M}\p{N}]+")
    line = pc.list_parent_indices(parts).to_numpy()
    coded = pc.dictionary_encode(pc.list_flatten(parts))
    out["words"] = np.bincount(line[np.asarray(pc.utf8_length(coded.dictionary))[coded.indices.to_numpy()] > 0], minlength=len(page)).astype(np.int32)
    word = _words(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    out["word"], out["word_line"] = word[word >= 0], line[word >= 0]
    # words that differ only by letters that are misread for each other are the same word
    same: dict[str, int] = {}
    number = np.array([_same_as(w, same) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    code = number[coded.indices.to_numpy()]
    line, code = line[code >= 0], code[code >= 0]
    _, inverse, n = np.unique(page[line].astype(np.int64) << 32 | code, return_inverse=True, return_counts=True)
    n, total = n[inverse], np.bincount(page[line], minlength=len(texts))[page[line]]
    content = np.bincount(line, minlength=len(page))
    out["content"] = content
    out["filling"] = np.bincount(line, weights=(n >= 3) & (n * FILLS >= total), minlength=len(page)) / np.maximum(content, 1)
    out["leading"] = np.bincount(line, weights=(n >= 4) & (n * LEADS >= total), minlength=len(page)) / np.maximum(content, 1)
    # different longer words of the page, and function words, of all its words
    firsts = np.unique(page[line].astype(np.int64) << 32 | code) >> 32
    of_page = lambda x: np.bincount(page, weights=x, minlength=len(texts))
    out["variety"] = (np.bincount(firsts, minlength=len(texts)) / np.maximum(of_page(content), 1))[page]
    out["fluency"] = (of_page(out["function"]) / np.maximum(of_page(out["words"]), 1))[page]
    out["numbered"] = (np.bincount(page, weights=out["numbers"] > 0, minlength=len(texts)) / np.maximum(np.bincount(page, minlength=len(texts)), 1))[page]
    return out


def _bins(value: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), value, side="left")


#: What is seen of a line: per feature the chances of its bins in a line of each label (prose, record,
#: notice, links, tags, menu), as a first guess. Each row adds up to 1. They stand for PRIOR_LINES lines and only tell training which
#: label is which; shapes and words start out the same for all labels.
EMISSIONS = {
    # share of function words: none, up to 0.12, up to 0.25, more
    "function": [[0.1, 0.2, 0.3, 0.4], [0.7, 0.2, 0.05, 0.05], [0.3, 0.3, 0.2, 0.2], [0.7, 0.2, 0.05, 0.05], [0.5, 0.2, 0.15, 0.15], [0.6, 0.2, 0.1, 0.1]],
    # share of longer words that fill the page: up to 0.2, 0.45, 0.7, more, no longer word
    "filling": [[0.7, 0.15, 0.05, 0.05, 0.05], [0.7, 0.15, 0.05, 0.05, 0.05], [0.4, 0.2, 0.15, 0.2, 0.05], [0.3, 0.2, 0.2, 0.2, 0.1], [0.1, 0.1, 0.25, 0.5, 0.05], [0.1, 0.1, 0.25, 0.45, 0.1]],
    # share of longer words that lead the page: none, up to 0.3, up to 0.6, more, no longer word
    "leading": [[0.85, 0.05, 0.03, 0.02, 0.05], [0.85, 0.05, 0.03, 0.02, 0.05], [0.6, 0.1, 0.1, 0.1, 0.1], [0.4, 0.2, 0.2, 0.1, 0.1], [0.15, 0.1, 0.3, 0.4, 0.05], [0.2, 0.2, 0.3, 0.2, 0.1]],
    # share of tokens that are joined by signs: none, up to 0.2, up to 0.5, more
    "joined": [[0.85, 0.1, 0.03, 0.02], [0.6, 0.15, 0.15, 0.1], [0.8, 0.1, 0.05, 0.05], [0.1, 0.1, 0.2, 0.6], [0.7, 0.15, 0.1, 0.05], [0.7, 0.15, 0.1, 0.05]],
    # share of digits: none, up to 0.06, up to 0.15, more
    "digits": [[0.7, 0.2, 0.08, 0.02], [0.3, 0.1, 0.2, 0.4], [0.5, 0.2, 0.2, 0.1], [0.4, 0.3, 0.2, 0.1], [0.7, 0.1, 0.15, 0.05], [0.85, 0.1, 0.03, 0.02]],
    # lines of the page with a number standing alone: none, up to 0.12, up to 0.25, more
    "numbered": [[0.3, 0.3, 0.2, 0.2], [0.2, 0.05, 0.05, 0.7], [0.2, 0.2, 0.2, 0.4], [0.6, 0.2, 0.1, 0.1], [0.5, 0.2, 0.1, 0.2], [0.7, 0.2, 0.05, 0.05]],
    # share of signs: up to 0.03, 0.06, 0.12, more
    "variety": [[0.2] * 5] * 6,
    "fluency": [[0.2] * 5] * 6,
    "signs": [[0.4, 0.4, 0.15, 0.05], [0.1, 0.2, 0.3, 0.4], [0.3, 0.3, 0.2, 0.2], [0.05, 0.1, 0.35, 0.5], [0.3, 0.3, 0.2, 0.2], [0.1, 0.2, 0.4, 0.3]],
    # share of words with a capital: none, up to 0.2, up to 0.5, more
    "capitals": [[0.25, 0.45, 0.25, 0.05], [0.1, 0.1, 0.2, 0.6], [0.15, 0.35, 0.35, 0.15], [0.5, 0.2, 0.2, 0.1], [0.4, 0.2, 0.2, 0.2], [0.6, 0.15, 0.15, 0.1]],
}
#: Features whose bins are learned together, as one tells something else beside the other.
JOINED = (("function", "filling"), ("numbered", "leading"))
START = [0.50, 0.10, 0.10, 0.10, 0.10, 0.10]
#: Chance that the next line has the same label, as a first guess; the rest is shared by the other labels.
STAY = 0.92
#: Labelled pages that training takes at most, in order of a hash of their ids; its rounds; how many lines of each label
#: the chances above stand for, and how many of each shape or word.
TRAIN_PAGES, TRAIN_ROUNDS, PRIOR_LINES, PRIOR_SYMBOL = 2000, 8, 30, 0.5
#: The weight of a shape or word beside the line's features (those of a line are alike), and the most that all of a line tell.
SYMBOL_WEIGHT, SYMBOL_MOST = 0.5, 8.0
#: A page is flagged from this share of words in link lists, tag lists and menus.
SHARE = 0.5
#: Pages of fewer words have next to no text.
LEAST_WORDS = 8


@dataclass(frozen=True)
class Model:
    """Chances of a hidden Markov model over lines: of what is seen given the label, of the first label, of
    the next label given this one."""

    emissions: dict[str, np.ndarray]
    start: np.ndarray
    move: np.ndarray


def prior() -> Model:
    k = len(LABELS)
    each = {n: np.array(t) for n, t in EMISSIONS.items()}
    for a, b in JOINED:
        x, y = each.pop(a), each.pop(b)
        each[f"{a} {b}"] = (x[:, :, None] * y[:, None, :]).reshape(k, -1)
    each |= {name: np.full((k, n), 1 / n) for name, n in SYMBOLS.items()}
    return Model(each, np.array(START), np.where(np.eye(k), STAY, (1 - STAY) / (k - 1)))


def observed(f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Bins of EMISSIONS per line."""
    words, chars, tokens = np.maximum(f["words"], 1), np.maximum(f["chars"], 1), np.maximum(f["tokens"], 1)
    filling, leading = _bins(f["filling"], [0.2, 0.45, 0.7]), _bins(f["leading"], [0, 0.3, 0.6])
    filling[f["content"] == 0] = leading[f["content"] == 0] = 4
    function, numbered = _bins(f["function"] / words, [0, 0.12, 0.25]), _bins(f["numbered"], [0, 0.12, 0.25])
    return {
        # what fills a page tells something else of lines with function words, and what leads it of pages with numbers
        "function filling": function * 5 + filling,
        "numbered leading": numbered * 5 + leading,
        "joined": _bins(f["joined"] / tokens, [0, 0.2, 0.5]),
        "digits": _bins(f["digits"] / chars, [0, 0.06, 0.15]),
        "variety": _bins(f["variety"], [0.1, 0.2, 0.3, 0.45]),
        "fluency": _bins(f["fluency"], [0.02, 0.08, 0.16, 0.24]),
        "signs": _bins(f["signs"] / chars, [0.03, 0.06, 0.12]),
        "capitals": _bins(f["capitals"] / words, [0, 0.2, 0.5]),
    }


def most_likely(page: np.ndarray, score: np.ndarray, model: Model) -> np.ndarray:
    """Label of each line by Viterbi: `page` ascending, `score` lines x labels of log chances. All pages go
    side by side, the longest first, so that each step is over the pages that still have a line."""
    first = np.nonzero(np.diff(page, prepend=-1))[0]
    length = np.diff(np.append(first, len(page)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    move = np.log(model.move)
    back = np.zeros(score.shape, dtype=np.int8)
    best = np.log(model.start) + score[first]
    end = np.zeros(len(page), dtype=np.int8)
    for t in range(1, int(length[0]) if len(length) else 0):
        on = int(np.searchsorted(-length, -t, side="left"))  # pages longer than t
        reach = best[:on, :, None] + move
        back[first[:on] + t] = reach.argmax(1)
        best[:on] = reach.max(1) + score[first[:on] + t]
    now = best.argmax(1).astype(np.int8)
    end[first + length - 1] = now
    for t in range(int(length[0]) - 1 if len(length) else 0, 0, -1):
        on = int(np.searchsorted(-length, -t, side="left"))
        at = first[:on] + t
        end[at - 1] = back[at, end[at]]
    return end


def _scores(f: dict[str, np.ndarray], seen: dict[str, np.ndarray], model: Model) -> np.ndarray:
    score = sum(np.log(model.emissions[name].T)[bins] for name, bins in seen.items())
    # what a symbol tells is how much more often it comes with a label than on the whole
    for name in SYMBOLS:
        table = model.emissions[name]
        told = np.log(table / table.mean(0)).T
        for i in range(len(LABELS)):
            each = np.bincount(f[f"{name}_line"], weights=told[f[name], i], minlength=len(score))
            score[:, i] += np.clip(SYMBOL_WEIGHT * each, -SYMBOL_MOST, SYMBOL_MOST)
    score[f["tokens"] == 0] = 0  # an empty line says nothing
    return score


def _shares(f: dict[str, np.ndarray], label: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.bincount(f["page"], weights=f["tokens"], minlength=pages)
    bad = np.bincount(f["page"], weights=f["tokens"] * (label >= LINKS), minlength=pages)
    return total.astype(np.int64), bad / np.maximum(total, 1)


def page_shares(texts, model: Model | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words, share of them in link lists, tag lists and menus) of each text of an Arrow array without nulls."""
    f = line_features(texts)
    model = model or prior()
    return _shares(f, most_likely(f["page"], _scores(f, observed(f), model), model), len(texts))


def count_lines(texts, spam: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    """How often each bin was seen with each label, each label came first and followed each other, in the most
    likely labels of labelled pages. A page that is no spam has only prose, records and notices, one that is spam no records
    or notices. Raters err, so that a few pages are forced into labels that do not fit; right pages outweigh them."""
    f = line_features(texts)
    seen = observed(f)
    score = _scores(f, seen, model)
    ordinary, kinds = spam[f["page"]] == 0, np.arange(len(LABELS))
    score[np.ix_(ordinary, kinds >= LINKS)] = -1e9
    score[np.ix_(~ordinary, np.isin(kinds, (RECORD, NOTICE)))] = -1e9
    label = most_likely(f["page"], score, model)
    k = len(LABELS)
    out = {}
    told = f["tokens"] > 0
    for name, bins in seen.items():
        out[name] = np.zeros(model.emissions[name].shape)
        np.add.at(out[name], (label[told], bins[told]), 1)
    for name, n in SYMBOLS.items():
        out[name] = np.bincount(label[f[f"{name}_line"]].astype(np.int64) * n + f[name], minlength=k * n).reshape(k, n).astype(float)
    begins = np.diff(f["page"], prepend=-1) > 0
    out["start"] = np.bincount(label[begins], minlength=k).astype(float)
    out["move"] = np.zeros((k, k))
    next_ = np.nonzero(~begins)[0]
    np.add.at(out["move"], (label[next_ - 1], label[next_]), 1)
    return out


def updated(counts: dict[str, np.ndarray], lines: float = PRIOR_LINES) -> Model:
    """The chances from counts, and from the first guess as if it had been seen in so many lines of each label."""
    base = prior()
    mean = lambda n, p, w: (n + w * p) / (n + w * p).sum(-1, keepdims=True)
    weight = {name: PRIOR_SYMBOL * SYMBOLS[name] if name in SYMBOLS else lines for name in base.emissions}
    return Model({name: mean(counts[name], p, weight[name]) for name, p in base.emissions.items()}, mean(counts["start"], base.start, lines), mean(counts["move"], base.move, lines))


def _parts(texts) -> Iterator[tuple[int, int]]:
    """(start, length) of parts of an Arrow array of texts that are labelled side by side."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size, dtype=np.int64) // PAGE_BYTES
    cuts = np.unique(np.concatenate([np.arange(0, len(size), PAGES), np.nonzero(np.diff(block))[0] + 1, [len(size)]]))
    yield from zip(cuts.tolist(), np.diff(cuts).tolist())


def agreed(labels: DataFrame) -> DataFrame:
    """(doc_id, _spam): the pages on which all raters that say something are of one mind."""
    return labels.where("is_spam in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("is_spam").alias("_spam")).where("_spam in (0, 1)")


def held_out(documents: DataFrame, labels: DataFrame, parts: int = 4) -> dict[str, float]:
    """Recall, precision and number of labelled pages, each judged by a model that has not seen it: the pages are put
    into `parts` by a hash of the id, and each part is judged by what was learned from the others."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(parts))
    told = checkpoint(documents.where("text is not null").select("doc_id", "text").join(agreed(labels), "doc_id").withColumn("_part", part))
    judged = None
    for i in range(parts):
        model = fit(documents, labels.where(part != i))
        own = non_prose_share(told.where(F.col("_part") == i), keep=("doc_id", "_spam"), model=model)
        judged = own if judged is None else judged.unionByName(own)
    hit, spam = (F.col("words") >= LEAST_WORDS) & (F.col("share") >= SHARE), F.col("_spam") == 1
    n, real, flagged, both = judged.agg(F.count("*"), F.count_if(spam), F.count_if(hit), F.count_if(hit & spam)).first()
    return {"pages": n, "recall": both / max(real, 1), "precision": both / max(flagged, 1)}


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", pages: int = TRAIN_PAGES, rounds: int = TRAIN_ROUNDS) -> Model:
    """Viterbi training on labelled pages: labels (doc_id, is_spam), of one or more raters.

    At most `pages` pages count, those on which the raters are of one mind, in order of a hash of their ids;
    without any, the model is the first guess. Tasks count, only the counts, some ten thousand
    numbers whatever the input, reach the driver.
    """
    some = agreed(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(pages)
    sample = checkpoint(documents.select("doc_id", documents[text].alias("_text")).where("_text is not null").join(F.broadcast(some), "doc_id").select("_text", "_spam"))
    model = prior()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for start, length in _parts(b["_text"]):
                part = b.slice(start, length)
                found = count_lines(part["_text"], part["_spam"].to_numpy(), model)
                for name, table in found.items():
                    at = np.nonzero(table.ravel())[0]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(table.ravel()[at])], names=["name", "i", "n"])

    for _ in range(rounds):
        got = sample.mapInArrow(run, "name string, i bigint, n double").groupBy("name", "i").agg(F.sum("n").alias("n")).collect()
        counts = {name: np.zeros(p.shape) for name, p in [*model.emissions.items(), ("start", model.start), ("move", model.move)]}
        for r in got:
            counts[r["name"]].ravel()[r["i"]] = r["n"]
        model = updated(counts)
    return model


def non_prose_share(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: Model | None = None) -> DataFrame:
    """`keep`, `words` and `share` (of words in link lists, tag lists and menus) of every row; words are what
    blanks separate. A null, empty or blank text has no words and a share of 0. Whole texts; no shuffle."""
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for start, length in _parts(b["_text"]):
                part = b.slice(start, length)
                words, share = page_shares(pc.fill_null(part["_text"], ""), model)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], pa.array(words), pa.array(share)], names=[*keep, "words", "share"])

    return documents.select(*keep, documents[text].alias("_text")).mapInArrow(run, f"{kinds}, words bigint, share double")


def stuffed_pages(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), share: float = SHARE, model: Model | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """`keep` of the pages of at least `least_words` words of which at least `share` are in link lists, tag
    lists or menus. Null, empty and blank texts are never flagged; equal texts are flagged alike."""
    found = non_prose_share(documents, text, keep, model).where((F.col("words") >= least_words) & (F.col("share") >= share))
    return found.select(*keep)
