"""Sentence units of texts in any language and script, as SQL expressions only.

Points that end no sentence (decimals, addresses, initials, abbreviations, ordinals, list numbers, quoted and bracketed
text) are masked with private-use characters, one for one, so that positions stay; then a mark is set after the
terminators of each script, the text is split at the marks, and the pieces are given as positions in the original text,
which restores the masked characters. All work is done within a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations that no sentence ends with; those in the second group only before a number, those in the
# third only before another word of their phrase.
ABBREVIATIONS = [
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Sra", "Dra", "Ing", "Dipl", "St", "vs", "e.g", "i.e", "cf", "vgl", "Vgl", "approx", "Approx", "env", "aprox", "Aprox", "ca", "Ca", "est", "Est",
    "incl", "inkl", "excl", "exkl", "max", "Max", "min", "Min", "máx", "mín", "typ", "nom", "Abschn", "Abb", "Tab", "Kap", "réf", "Réf", "núm", "Núm", "pág", "págs", "ggf", "bzw", "evtl", "sog", "Fig", "Figs",
    "напр", "рис", "Рис", "табл", "см", "См", "ср", "Инж", "инж", "проф", "г-н", "डॉ", "श्री",
]
NUMBERED = ["No", "Nos", "Nr", "Nº", "no", "nr", "fig", "figs", "p", "pp", "S", "sec", "Sec", "rev", "Rev", "ver", "Ver", "vol", "Vol", "ch", "art", "Art", "п", "с", "стр", "гл", "№"]
# the two words of phrases of which each has a point
PHRASES = [("z", "B"), ("d", "h"), ("u", "a"), ("s", "S"), ("i", "e"), ("e", "g"), ("p", "ex"), ("p", "ej"), ("EE", "UU"), ("т", "е"), ("т", "д"), ("т", "к")]
# What goes on with the sentence after a closed quotation or bracket in Chinese and Japanese.
GOES_ON = "并|的|字样|等|和|与|而|と|の|を|が|は|に|も|で|や|へ|、|，|,|；|：|。|！|？"

# private-use characters, one meaning each
_DOT, _QUOTED, _QUOTED_CJK, _QUOTED_DANDA = "\ue001", "\ue002", "\ue003", "\ue004"
_OPEN, _CLOSE, _POPEN, _PCLOSE = "\ue020", "\ue021", "\ue022", "\ue023"
_CUT = "\ue0ff"

# blanks other than the space and the line feed
_ODD = r"[\t\x0b-\r\x1c-\x1f\x85\p{Z}&&[^ ]]"
_THAI = r"฀-๿"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_START = rf"(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\d{_OPEN}{_POPEN}¿¡—–\[<]|pH\b)"
_LATIN_START = rf"(?:\p{{Lu}}\p{{Ll}}|\p{{Lu}}\s\p{{L}}|pH\s|[{_OPEN}¿¡—][\p{{L}}¿¡]|[{_CJK}\p{{IsDevanagari}}{_THAI}])"
_END = rf"[{_CLOSE}{_PCLOSE}]"

#: Lengths of lines among which the width of wrapped texts is looked for.
_WIDTHS = range(40, 201)

_BULLET = r"[-*•–·‣▪]"
_NOT_WORD = r"(?<![\p{L}\p{M}\p{N}.])"


def wrap_width(df: DataFrame, text: str) -> int | None:
    """The width at which the texts of a corpus are wrapped; null when they are not.

    A line end is a wrap at every width from its line's length to that with the next word. All line ends are counted, at each
    length how many such ranges begin and end (a row per length comes back); the width is where the most ranges that are
    gone ten characters later meet, at least three times as many as there.
    """
    lines = df.where(F.contains(F.col(text), F.lit("\n"))).select(F.split(F.col(text), "\n").alias("l"))
    size = lambda x: F.length(F.rtrim(F.replace(x, F.lit("\r"), F.lit(""))))
    word = lambda x: F.length(F.substring_index(F.ltrim(x), " ", 1))
    ends = F.transform(F.slice("l", F.lit(1), F.size("l") - 1), lambda x, i: F.struct(size(x).alias("n"), word(F.get("l", i + 1)).alias("w")))
    x = lines.select(F.inline(ends)).where((F.col("w") > 0) & F.col("n").between(1, _WIDTHS[-1]))
    points = F.array(F.struct(F.col("n").alias("at"), F.lit(1).alias("d")), F.struct(F.least(F.col("n") + 1 + F.col("w"), F.lit(_WIDTHS[-1] + 1)).alias("at"), F.lit(-1).alias("d")))
    change = {r["at"]: r["d"] for r in x.select(F.inline(points)).groupBy("at").agg(F.sum("d").alias("d")).collect()}
    over = [sum(change.get(i, 0) for i in range(w + 1)) for w in range(_WIDTHS[-1] + 1)]
    falls = [(over[w] - over[w + 10], -w) for w in _WIDTHS[:-10] if over[w] >= 3 * over[w + 10] and over[w] > 0]
    return -max(falls)[1] if falls else None


def _wrap(width: int) -> str:
    """A line end behind a line of at most the width, before a word that did not fit (allowing for three characters, as texts are damaged)."""
    fits = "|".join(rf"(?<=[^\n]{{{n}}}\n)(?=\S{{{max(1, width - 4 - n)}}})" for n in range(width - 2, max(width - 38, 3), -4))
    return rf"\n(?<![^\n]{{{width + 11}}}\n)(?:{fits})"


def _before_point(words: list[str]) -> str:
    """Before the point just read stands one of the words; tried once per length of word."""
    sizes: dict[int, list[str]] = {}
    for w in words:
        sizes.setdefault(len(w), []).append(w.replace(".", r"\."))
    return "|".join(rf"(?<={_NOT_WORD}(?:{'|'.join(w)})\.)" for _, w in sorted(sizes.items()))


def _lines(text: Column, width: int | None) -> Column:
    """List numbers masked, wrapped lines joined; the length stays."""
    number = rf"( {{0,8}}\d{{1,3}})\.(?= +\S)"
    t = F.regexp_replace(text, f"^{number}", f"$1{_DOT}")
    # the number of a list line; a wrapped line may also begin with a number and a point
    ref = "|".join(w.replace(".", r"\.") for w in [*NUMBERED, *ABBREVIATIONS])
    many = F.regexp_replace(t, rf"\n{number}(?<![^\n]{{50}}[^\n.!?:;。！？…\"”»)\]] {{0,1}}\n {{0,8}}\d{{1,3}}\.)(?<!(?:{ref})\. {{0,1}}\n {{0,8}}\d{{1,3}}\.)", f"\n$1{_DOT}")
    if width:
        # line ends next to Thai text, before list lines and behind short lines stay
        many = F.regexp_replace(many, rf"{_wrap(width)}(?<![{_THAI}] {{0,1}}\n)(?![{_THAI}]| {{0,8}}(?:{_BULLET}|\d{{1,3}}[{_DOT})]) )", " ")
    return F.when(F.contains(t, F.lit("\n")), many).otherwise(t)


def _pairs(t: Column, mark: str, inside: str, end: str, opening: str, closing: str) -> Column:
    """Pairs of marks of one kind in one line, as the two marks for all kinds; a text without the first one is passed on."""
    found = F.regexp_replace(t, f"{_escaped(mark)}([^{inside}\\n]++)[{end}]", f"{opening}$1{closing}")
    return F.when(F.contains(t, F.lit(mark)), found).otherwise(t)


def _escaped(mark: str) -> str:
    return "\\" + mark if mark in "([" else mark


# opening mark, what may not stand inside, closing marks
_QUOTES = [("„", "„“”\"", "“”\""), ("“", "“”", "”"), ("«", "«»", "»"), ("「", "「」", "」"), ("『", "『』", "』"), ("\"", "\"", "\"")]
_BRACKETS = [("(", "()", ")"), ("（", "（）", "）"), ("[", "\\[\\]", "\\]"), ("【", "【】", "】")]


def _points(t: Column) -> Column:
    """Points that end nothing, masked: one pass, in which only points are looked at.

    A point before a blank and a small letter ends no sentence as it is, so only others are compared with the words.
    """
    firsts, seconds = sorted({a for a, _ in PHRASES}), sorted({b for _, b in PHRASES}, key=len, reverse=True)
    kinds = "|".join([
        r"(?=\d)(?<=\d\.)",
        r"(?=[\p{Ll}\d\-_/]{2,}[./@\-]|(?:com|org|net|io|de|fr|example|invalid|test)\b)(?<=[\p{L}\p{N}\-_/]\.)",
        rf"(?=\s?(?:{'|'.join(seconds)})\.)(?:{_before_point(firsts)})",
        rf"(?!\s\p{{Ll}})(?:{_before_point([f'{a}.{gap}{b}' for a, b in PHRASES for gap in ('', ' ')])}|{_before_point(ABBREVIATIONS)})",
        rf"(?=\s{{0,2}}\d)(?:{_before_point(NUMBERED)})",
        # initials and titles of one letter; after a number the letter is a unit
        r"(?=\s\p{Lu})(?<=(?<![\p{L}\p{M}\p{N}.°])(?<!\d\s)\p{Lu}\.)",
        # ordinals
        r"(?=\s\p{L})(?<=\d\.)(?<=\b(?:der|dem|den|des|die|das|am|vom|zum|im|beim|bis)\s\d{1,3}\.)",
        r"(?=\s(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Auflage)\b)(?<=\d\.)",
    ])
    t = F.regexp_replace(t, rf"\.(?:{kinds})", _DOT)
    # an ellipsis inside a sentence
    return F.when(F.contains(t, F.lit("...")), F.regexp_replace(t, r"\.\.\.(?!\s+\p{Lu}|\s*(?:\n|$))", _DOT * 3)).otherwise(t)


def _inside(t: Column, opening: str, closing: str) -> Column:
    """Terminators between two marks, masked: in each piece up to a closing mark what stands behind the last opening one."""
    ends, masks = ".!?。！？｡…।॥", _QUOTED * 3 + _QUOTED_CJK * 5 + _QUOTED_DANDA * 2

    def masked(s: Column, n: Column) -> Column:
        tail = F.substring_index(s, opening, -1)
        return F.when(n > 0, F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(tail)), F.translate(tail, ends, masks))).otherwise(s)

    pieces = F.split(t, closing)
    some = t.rlike(f"{opening}[^{closing}\n{ends}]*+[{ends}]")
    return F.when(some, F.array_join(F.transform(pieces, lambda s, i: masked(s, F.size(pieces) - 1 - i)), closing)).otherwise(t)


def _marked(masked: Column) -> Column:
    """The masked text with a cut mark after each sentence."""
    cuts = [
        r"\n+",
        rf"[.!?]+{_END}*(?=\s+{_START})",  # a terminator before a blank and a beginning
        rf"[.!?](?<![.][.]){_END}*(?={_LATIN_START})",  # the blank is missing
        r"\.(?=\d+\s\p{Ll})(?<=\p{Ll}{3}\.)",
        rf"…{_END}*(?=\s+\p{{Lu}})",
        rf"{_QUOTED}{_END}+(?=\s+(?:[\p{{Lu}}\d{_OPEN}¿¡—]|pH\b|[{_CJK}{_THAI}])|\p{{Lu}}\p{{Ll}}|[{_CJK}])",
        rf"{_QUOTED_CJK}{_END}+(?!\s*(?:{GOES_ON}|{_END}))",
        rf"[。！？｡]+[!?]*{_END}*",
        rf"[।॥]+{_END}*",
    ]
    thai = [rf" +(?=[{_THAI}])(?<=[{_THAI}] {{1,9}})", rf" +(?=\p{{Lu}}\p{{Ll}}*\s\p{{Ll}})(?<=[{_THAI}] {{1,9}})"]
    first = rf"\n\p{{Po}}{_QUOTED}-{_QUOTED_CJK}"  # most characters fail here
    plain = F.regexp_replace(masked, f"(?=[{first}])(?:{'|'.join(cuts)})", "$0" + _CUT)
    blanks = F.regexp_replace(masked, f"(?=[{first} ])(?:{'|'.join([*cuts, *thai])})", "$0" + _CUT)
    return F.when(masked.rlike(f"[{_THAI}] "), blanks).otherwise(plain)


def _positions(pieces: Column) -> Column:
    """Array of struct(start_pos, end_pos) of the pieces that are not blank: blocks of 64 keep it linear for texts of very many sentences."""
    block = 64
    spans = "array<struct<start_pos:int,end_pos:int>>"
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / block).cast("int")), lambda b: F.slice(pieces, b * block + 1, F.lit(block)))

    def starts(sizes: Column) -> Column:
        kind = "struct<at:int,out:array<int>>"
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(kind)
        return F.aggregate(sizes, first, step)["out"]

    def run(values: Column, start: Column) -> Column:
        kind = f"struct<at:int,out:{spans}>"
        first = F.struct(start.alias("at"), F.array().cast(spans).alias("out")).cast(kind)

        def step(acc: Column, s: Column) -> Column:
            begin = acc["at"] + F.length(s) - F.length(F.ltrim(s))
            span = F.array(F.struct(begin.alias("start_pos"), (begin + F.length(F.trim(s))).alias("end_pos")))
            return F.struct((acc["at"] + F.length(s)).alias("at"), F.when(F.trim(s) == "", acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out")).cast(kind)

        return F.aggregate(values, first, step)["out"]

    size = lambda b: F.length(F.array_join(b, ""))
    every = F.transform(F.arrays_zip(blocks.alias("b"), starts(F.transform(blocks, size)).alias("s")), lambda p: run(p["b"], p["s"]))
    return F.when(F.size(pieces) <= block, run(pieces, F.lit(0))).otherwise(F.flatten(every))


def split_sentences(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per sentence: ``row_id, start_pos, end_pos`` (code points, 0-based, end exclusive, without blanks around).

    A null, empty or blank text has no sentence. Repeated rows give repeated sentences. A text without any terminator is
    one sentence per line. Together the sentences cover all that is not blank. Other columns of ``df`` are not read.
    """
    x = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("_t")).where("_t is not null")
    width = wrap_width(x, "_t")
    # in layers: each column is used several times by the next one
    layer = lambda d, c: d.select("row_id", c.alias("_m"))
    x = layer(x, F.when(F.col("_t").rlike("[\ue000-\uf8ff]"), F.regexp_replace("_t", "[\ue000-\uf8ff]", "x")).otherwise(F.col("_t")))
    x = layer(x, F.regexp_replace("_m", _ODD, " "))
    x = layer(x, _lines(F.col("_m"), width))
    for mark in _QUOTES:
        x = layer(x, _pairs(F.col("_m"), *mark, _OPEN, _CLOSE))
    for mark in _BRACKETS:
        x = layer(x, _pairs(F.col("_m"), *mark, _POPEN, _PCLOSE))
    x = layer(x, _points(F.col("_m")))
    for opening, closing in ((_OPEN, _CLOSE), (_POPEN, _PCLOSE)):
        x = layer(x, _inside(F.col("_m"), opening, closing))
    x = layer(x, _marked(F.col("_m")))
    x = x.select("row_id", F.split(F.replace("_m", F.lit("\n"), F.lit(" ")), _CUT).alias("_s"))
    return x.select("row_id", F.inline(_positions(F.col("_s"))))
