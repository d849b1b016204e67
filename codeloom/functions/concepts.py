"""Which constructs of the language a piece of source shows, from the scanner's tokens and their brackets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from codeloom.functions.scanner import KEYWORDS, MODIFIERS, TYPES, tokens

# What is said of a construct, in this order.
LABELS = {
    "generic": "contains generic syntax", "conditional": "contains a null-conditional operator", "coalesce": "contains a null-coalescing operator", "query": "contains a LINQ query expression",
    "creation": "contains object creation syntax", "invocation": "contains invocation syntax", "lambda": "contains lambda syntax", "property": "contains property declaration syntax",
    "event": "contains event declaration syntax", "constructor": "contains constructor declaration syntax", "static": "contains static member syntax",
}
_AFTER_TYPE = frozenset("( ) ] } : ; , . ?. ? == != { > [ => && || = &".split())
_BEFORE_LAMBDA = frozenset("( , = return => async static : ? ?? { ; [ &&".split()) | {""}
_ACCESSORS = frozenset("get set init private protected internal [".split())


class _Text:
    """Tokens of a text with what each bracket closes with and what each token stands in."""

    def __init__(self, text: str):
        found = list(tokens(text))
        self.group, self.text = [t[0] for t in found], [t[1] for t in found]
        self.partner, self.around, open_ = {}, [], []
        for i, t in enumerate(self.text):
            self.around.append(open_[-1] if open_ else -1)
            if t in ("(", "{", "[", "?["):
                open_.append(i)
            elif t in (")", "}", "]") and open_:
                self.partner[open_[-1]] = i
                self.partner[i] = open_.pop()

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def word(self, i: int) -> bool:
        """A name, not a word of the language."""
        return 0 <= i < len(self.text) and self.group[i] == "word" and self.text[i] not in KEYWORDS

    def type_end(self, i: int) -> bool:
        """Whether a type may end here, so that a name after it is declared."""
        return (self.word(i) and self.text[i] not in MODIFIERS) or self.at(i) in (">", "]", "?")

    def generic_end(self, i: int) -> int:
        """The closing sign of type arguments that open here, -1 if they are none."""
        if self.at(i) != "<" or not self.word(i - 1):
            return -1
        depth = 0
        for j in range(i, len(self.text)):
            t = self.text[j]
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j if j > i + 1 and (self.at(j + 1) in _AFTER_TYPE or self.at(j + 1) == "" or self.group[j + 1] == "word") else -1
            if not (self.word(j) or t in "<>,.?[]()" or t == "::"):
                return -1
        return -1

    def header(self, brace: int) -> list[str]:
        """The words before an opening brace, back to the end of what stands before."""
        j = brace - 1
        while j >= 0 and self.text[j] not in (";", "{", "}"):
            j = self.partner.get(j, j) - 1 if self.text[j] in (")", "]") else j - 1
        return self.text[j + 1 : brace]


def _calls(t: _Text) -> Iterator[tuple[int, bool]]:
    """(the opening bracket, whether a constructor is declared) of what is called or constructed by name."""
    generics = {t.generic_end(i): i for i in range(len(t.text)) if t.text[i] == "<"}
    for i, sign in enumerate(t.text):
        if sign != "(" or i == 0:
            continue
        end = generics.get(i - 1, i) - 1 if t.at(i - 1) == ">" and i - 1 in generics else i - 1
        if not t.word(end):
            if t.at(i - 1) in (")", "]") and t.at(t.partner.get(i - 1, i) - 1) not in ("if", "while", "for", "foreach", "switch", "using", "lock", "catch", "fixed", "typeof", "sizeof", "default"):
                casts = t.at(i - 1) == ")" and (not t.word(t.partner.get(i - 1, i) - 1))
                if not casts and t.at(i - 1) != "]" or t.at(i - 1) == "]" and t.word(t.partner.get(i - 1, i) - 1):
                    yield i, False
            continue
        first = end
        while t.at(first - 1) in (".", "::", "?.") and (t.word(first - 2) or t.at(first - 2) in (")", "]", ">", "this", "base")):
            if not t.word(first - 2):
                first -= 1
                break
            first -= 2
        before, close = t.at(first - 1), t.partner.get(i, len(t.text))
        if before == "new" or (t.at(end) in ("base", "this") and before == ":"):
            continue
        if before == "[" and not (t.word(first - 2) or t.at(first - 2) in (")", "]")):  # an attribute
            continue
        follows = t.at(close + 1)
        if first == end and end == i - 1 and (before in MODIFIERS or before in ("{", "}", ";", "]", "")) and (follows == "{" or (follows == ":" and t.at(close + 2) in ("base", "this")) or (follows == "=>" and before in MODIFIERS)):
            yield i, True
        elif not t.type_end(first - 1) and before not in MODIFIERS:
            yield i, False


def concepts(text: str | None) -> list[str]:
    """The labels of the constructs that a text shows."""
    t = _Text(text or "")
    n, hit = len(t.text), set()
    for i, sign in enumerate(t.text):
        if sign == "<" and t.generic_end(i) > 0:
            hit.add("generic")
        elif sign == "?." or (sign == "?[" and t.at(i + 1) not in ("]", ",")):
            hit.add("conditional")
        elif sign == "??":
            hit.add("coalesce")
        elif sign == "from" and t.at(i - 1) != "." and t.word(i + 1) and any(t.at(j) == "in" for j in (i + 2, i + 3)):
            hit.add("query")
        elif sign == "new" and t.word(i + 1):
            j = i + 1
            while t.at(j + 1) in (".", "::") and t.word(j + 2):
                j += 2
            closing = t.generic_end(j + 1)
            if t.at((closing if closing > 0 else j) + 1) in ("(", "{"):
                hit.add("creation")
        elif sign == "event" and t.group[i] == "word":
            stop = next((j for j in range(i, n) if t.text[j] in ("{", ";", "=")), n)
            if t.at(stop) == "{":
                hit.add("event")
        elif sign == "=>":
            switch = t.around[i] >= 0 and t.at(t.around[i]) == "{" and t.at(t.around[i] - 1) == "switch"
            left = t.partner.get(i - 1, i - 1) if t.at(i - 1) == ")" else i - 1
            if not switch and (t.at(i - 1) == ")" or t.word(i - 1)) and t.at(left - 1) in _BEFORE_LAMBDA and not (left == 0 and t.at(i - 1) != ")" and n == i + 1):
                hit.add("lambda")
            elif t.word(i - 1) and t.type_end(i - 2):
                hit.add("property")
        elif sign == "{" and t.word(i - 1) and t.type_end(i - 2) and t.at(i + 1) in _ACCESSORS and "event" not in t.header(i):
            hit.add("property")
        elif sign == "static" and t.at(i - 1) != "using" and t.at(i + 1) != "(" and t.at(i + 2) != "=>":
            around = t.around[i]
            if around < 0 or (t.at(around) == "{" and any(w in (*TYPES, "namespace") for w in t.header(around))):
                hit.add("static")
    for _, made in _calls(t):
        hit.add("constructor" if made else "invocation")
    return [label for name, label in LABELS.items() if name in hit]


@F.pandas_udf(ArrayType(StringType()))
def _concepts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([concepts(t) for t in batch], index=batch.index)


def shown(files: DataFrame) -> DataFrame:
    """path, place, concept of files (path, text), in their order."""
    return files.select("path", F.posexplode(_concepts("text")).alias("place", "concept"))
