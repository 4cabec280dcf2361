"""Licence scan by the Dice coefficient over word bigrams (native).

A text is normalised as a whole (lower case, letters and digits only, other runs as one space, line breaks included), so a notice may be
wrapped over lines or stand inside a longer one. Windows of its words are compared with templates (notices, identifiers, titles, headers, paragraphs):
``2 |A & B| / (|A| + |B|)`` for the sets of word bigrams A and B. A window has as many words as the template, and is placed so that a bigram
of the text lies where the template has it. For a coefficient of t, ``t / (2 - t)`` of the template's bigrams must be in the window, so of any larger
rest of them one is: windows are placed at the ``anchors`` only, such a rest for every template, chosen from long words.
As the intersection is at most the smaller set, a coefficient of t also needs ``|A|`` between ``t / (2 - t)`` and ``(2 - t) / t`` times
``|B|``: other windows are not compared. Of windows that overlap, the one with the highest coefficient stays, then the
longer template, the first licence by name, the first place.

All work is inside the row: no shuffle, no skew; the templates are literals in the plan. Texts without an anchor are not split at all.

Defined cases: null text and texts of fewer than two words have no licence; a very long text is one list of words; a word inserted into a
notice costs the bigrams around it and those past the window's end; repeated rows are judged alike; an empty table gives an empty result;
columns named like the outputs are replaced.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcoder.llm.license_templates import TEMPLATES

THRESHOLD = 0.8


def template_words(text: str) -> list[str]:
    """Words of a template, by the rules of ``words``."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template."""
    low = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(low, low[1:], strict=False)})


def words(text: Column) -> Column:
    """Words of a normalised text (letters of other scripts count as letters)."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest bigram set that can reach the threshold with one of size n."""
    near = [m for m in range(1, int(n * 2 / threshold) + 2) if 2 * min(m, n) / (m + n) >= threshold]
    return near[0], near[-1]


def anchors(sets: list[list[str]], threshold: float) -> list[str]:
    """Bigrams of which a window has at least one if it reaches the threshold with any of the bigram sets.

    The window then shares ``t / (2 - t)`` of the set at least, so more bigrams than the rest of it will do; those of long
    words, which are rare in other texts, come first, then those of most sets.
    """
    chosen: set[str] = set()
    while True:
        short = [b for b in sets if sum(g in chosen for g in b) <= len(b) * (1 - threshold / (2 - threshold)) + 1e-9]
        if not short:
            return sorted(chosen)
        gain = Counter(g for b in short for g in b if g not in chosen)
        chosen.add(max(gain, key=lambda g: (min(5, *map(len, g.split())), gain[g], g)))


def placements(templates: list[tuple[str, str]], threshold: float) -> dict[str, list[tuple[int, int]]]:
    """For each anchor the templates that hold it, and its word position in them."""
    marks = set(anchors([template_bigrams(t) for _, t in templates], threshold))
    found = defaultdict(list)
    for i, (_, t) in enumerate(templates):
        low = template_words(t)
        for k, (a, b) in enumerate(zip(low, low[1:], strict=False)):
            if f"{a} {b}" in marks:
                found[f"{a} {b}"].append((i, k))
    return dict(sorted(found.items()))


def _any_of(bigrams: list[str]) -> str:
    """Pattern of any of the bigrams with other characters between; alternatives are grouped by first letter and word, which makes them fast."""
    tree: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for a, b in (g.split() for g in sorted(bigrams)):
        tree[a[0]][a[1:]].append(b)
    words_of = [first + "(?:" + "|".join(rf"{rest}[^\p{{L}}\p{{N}}]++(?:{'|'.join(after)})" for rest, after in sorted(some.items(), reverse=True)) + ")"
                for first, some in sorted(tree.items())]
    return f"(?:{'|'.join(words_of)})"


def licences_of(text: Column, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> Column:
    """Array of structs (dice, n, licence, first, last): the best windows of a text, which do not overlap, by their word positions."""
    at = placements(templates, threshold)
    rows = []
    for name, t in templates:
        grams = template_bigrams(t)
        lo, hi = size_bounds(len(grams), threshold)
        rows.append({"name": name, "words": len(template_words(t)), "n": len(grams), "lo": lo, "hi": hi, "grams": grams})
    # No literal is written out twice: they are columns of the row that is looked at.
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,words:int,n:int,lo:int,hi:int,grams:array<string>>>")
    places = F.from_json(F.lit(json.dumps({g: [{"t": i, "k": k} for i, k in v] for g, v in at.items()})), "map<string,array<struct<t:int,k:int>>>")
    firsts = F.array(*[F.lit(w) for w in sorted({g.split()[0] for g in at})])
    holds = F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}]){_any_of(list(at))}(?![\p{{L}}\p{{N}}])")

    def bigram(all_words: Column, i: Column) -> Column:
        return F.concat(F.get(all_words, i), F.lit(" "), F.get(all_words, i + 1))

    def windows(all_words: Column, i: Column) -> Column:
        """Windows of the templates that hold the bigram at word i there."""
        def compared(p: Column) -> Column:
            t, start = F.get(listed, p["t"]), i - p["k"]

            def result(grams: Column) -> Column:
                dice = F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])
                return F.struct(F.when(F.size(grams).between(t["lo"], t["hi"]), dice).alias("dice"), t["n"].alias("n"), t["name"].alias("licence"),
                                start.alias("first"), (start + t["words"] - 1).alias("last"))

            inside = (start >= 0) & (start + t["words"] <= F.size(all_words))
            return F.when(inside, _let(F.array_distinct(F.transform(F.sequence(start, start + t["words"] - 2), lambda j: bigram(all_words, j))), result))

        found = F.transform(F.element_at(places, bigram(all_words, i)), compared)
        return F.filter(found, lambda x: x["dice"] >= threshold)

    def apart(ordered: Column) -> Column:
        """Of windows in order of preference, those that overlap none before them."""
        none = F.filter(ordered, lambda _: F.lit(False))
        return F.aggregate(ordered, none, lambda kept, x: F.when(
            F.exists(kept, lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"])), kept).otherwise(F.array_append(kept, x)))

    def of_words(w: Column) -> Column:
        # Positions whose word begins an anchor, then those with the anchor itself.
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.array_contains(firsts, F.get(w, i)))
        found = F.flatten(F.filter(F.transform(starts, lambda i: windows(w, i)), lambda x: x.isNotNull()))
        best = _let(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct(
            (-x["dice"]).alias("worse"), (-x["n"]).alias("shorter"), x["licence"].alias("licence"), x["first"].alias("first"),
            x["last"].alias("last"))))), apart)
        return F.array_sort(F.transform(best, lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["licence"].alias("licence"),
                                                                  (-x["worse"]).alias("dice"))))

    return F.when(holds, _let(words(text), lambda w: F.when(F.size(w) >= 2, of_words(w))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(df: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
         out: str = "licences") -> DataFrame:
    """``df`` with the licences that its text names (first and last word position, licence, dice), in order of the text (empty: none)."""
    return df.withColumn(out, F.coalesce(licences_of(F.col(text), templates or TEMPLATES, threshold), F.array()))
