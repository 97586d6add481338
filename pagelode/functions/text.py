"""Tokens, stems and stop words as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words and parts of web addresses.
ENGLISH_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might can shall this that these those it its he his she her they them their we our you your i me my mine "
    "what which who whom when where why how all each every both few more most other some such no nor not only own same so than "
    "too very just about up out down over under again further then once here there also if because as until while after before "
    "above below between through during into throughout despite unless whenever wherever however moreover therefore thus hence "
    "since www com org net edu gov io html htm http https ftp"
).split()
# Chinese stop words.
CHINESE_STOP_WORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没 看 好 自己 这 那 他 她 它 们 而 与 及 "
    "或 但 然 则 虽 既 又 且 并 等 等等 之类 什么 怎么 为什么 如何 可以 能 能够 应该 必须 需要 知道 明白 理解 觉得 认为 "
    "因为 所以 因此 于是 如果 假如 假设 即使 虽然 但是 不过 然而 其实 实际上 事实上 当然 显然 这个 那个 这些 那些 这样 那样 "
    "这里 那里 现在 过去 将来 已经 正在 将要 曾经 一直 总是 经常 常常 偶尔 有时 从不 绝不 中 内 外 下 左 右 前 后 里 "
    "之间 之中 之内 之外 以上 以下 以前 以后 为 以 还 再 已"
).split()
STOP_WORDS = (*ENGLISH_STOP_WORDS, *CHINESE_STOP_WORDS)
# Stop words of keyword extraction, the English ones up to "during".
KEYWORD_STOP_WORDS = tuple(ENGLISH_STOP_WORDS[: ENGLISH_STOP_WORDS.index("during") + 1])
# Suffix, replacement, and the length that a word must exceed; the first that fits applies.
STEM_RULES = (
    ("sses", "ss", 3), ("ies", "i", 3), ("ss", "ss", 2), ("s", "", 3),
    ("eed", "ee", 3), ("ed", "", 3), ("ing", "", 3),
    ("ational", "ate", 5), ("tional", "tion", 5), ("enci", "ence", 4), ("anci", "ance", 4), ("izer", "ize", 4), ("abli", "able", 4),
    ("alli", "al", 4), ("entli", "ent", 5), ("eli", "e", 3), ("ousli", "ous", 4), ("ization", "ize", 6), ("ation", "ate", 5),
    ("ator", "ate", 4), ("alism", "al", 5), ("iveness", "ive", 6), ("fulness", "ful", 6), ("ousness", "ous", 6),
    ("al", "", 3), ("ance", "", 4), ("ence", "", 4), ("er", "", 3), ("ic", "", 3), ("able", "", 4), ("ible", "", 4),
    ("ment", "", 4), ("ness", "", 4), ("ful", "", 3), ("ous", "", 3), ("ive", "", 3), ("ize", "", 3),
)


def stem(word: Column) -> Column:
    """The stem of a lower-case word of letters; words of up to three letters, or with a digit, stay.

    Rules are asked by the last letter, in their order: rules of other letters cannot fit. Best computed within a lambda (see
    stems): in generated code the many branches make one method that is too large to be compiled at run time."""
    by_last: dict[str, list[tuple[str, str, int]]] = {}
    for rule in STEM_RULES:
        by_last.setdefault(rule[0][-1], []).append(rule)
    out = F.when((F.length(word) <= 3) | ~word.rlike("^[a-z]+$"), word)
    for last, rules in by_last.items():
        own = None
        for suffix, replacement, least in rules:
            test = word.endswith(suffix) & (F.length(word) > least) if least > 3 else word.endswith(suffix)
            stemmed = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(replacement))
            own = F.when(test, stemmed) if own is None else own.when(test, stemmed)
        out = out.when(word.endswith(last), own.otherwise(word))
    return out.otherwise(word)


def stems(words_: Column) -> Column:
    """Of an array of words."""
    return F.transform(words_, stem)


def _grams(run: Column, n: int) -> Column:
    starts = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))


def words(text: Column) -> Column:
    """Tokens before stemming: Latin words of two letters or more, then 2- and 3-grams of Chinese runs, no stop words."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]*"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]+"), F.lit(0))
    chinese = F.flatten(F.transform(runs, lambda r: F.concat(_grams(r, 2), _grams(r, 3))))
    kept = F.filter(F.concat(latin, chinese), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def tokenize(text: Column, stemming: bool = True) -> Column:
    return stems(words(text)) if stemming else words(text)


def runs(ordered: Column, of, key=lambda x: x["term"]) -> Column:
    """of(array, first, n) for each run of n equal keys, from place first, in a sorted array: groups of one row, in time with its length."""

    def found(a):
        places = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: ~key(F.get(a, i - 1)).eqNullSafe(key(F.get(a, i - 2))))
        return bound(starts, lambda s: F.transform(s, lambda first, k: of(a, first, F.coalesce(F.get(s, k + 1), F.size(a) + 1) - first)))

    return bound(ordered, found)


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def plain_words(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
