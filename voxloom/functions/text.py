"""Text expressions."""

from pyspark.sql import Column, functions as F


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What case folding still changes in lower-cased text: to one character, and to more."""
    one, more = {}, {}
    for c in map(chr, range(0x20000)):
        folded = c.casefold()
        if c.lower() == c != folded:
            (one if len(folded) == 1 else more)[c] = folded
    return one, more


FOLD_ONE, FOLD_MORE = _folds()


# Lower-cased text of these characters alone needs no more than its sharp s written out.
_LATIN = r"[^\x{0}-\x{B4}\x{B6}-\x{148}]"


def _any_of(characters) -> str:
    """A regular expression for any of the characters, neighbours drawn together."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def case_fold(text: Column) -> Column:
    """Full case folding.

    Almost all texts are done after lower-casing, or after that and the sharp s: ASCII is known
    by its length in bytes, Latin by one scan.  What case folding changes besides is rare, and
    only texts that hold such a character are translated.
    """
    low = F.lower(text)
    single = F.translate(low, "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    wide = single
    for c, folded in FOLD_MORE.items():
        wide = F.replace(wide, F.lit(c), F.lit(folded))
    sharp = F.replace(low, F.lit("ß"), F.lit("ss"))
    others = _any_of(({*FOLD_ONE} | {*FOLD_MORE}) - {"ß"})
    return (
        F.when(F.octet_length(text) == F.char_length(text), low)
        .when(~low.rlike(_LATIN) | ~low.rlike(others), sharp)
        .otherwise(wide)
    )


def normalize_text(text: Column) -> Column:
    """Case-folded text without non-word characters (accents and CJK are kept)."""
    folded = case_fold(text)
    return F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", "")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def instruction_input(text: Column, instruction: str | None) -> Column:
    """Prefix an encoder instruction; without one the text passes through."""
    if not instruction:
        return text
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text)


def or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def is_safe_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")


def is_safe_path(path: Column) -> Column:
    """Relative, non-empty, and never climbing out of its root."""
    unified = F.trim(F.regexp_replace(path, r"\\", "/"))
    return (
        (F.length(unified) > 0)
        & ~unified.startswith("/")
        & ~F.array_contains(F.split(unified, "/"), "..")
    )


def stays_inside_root(path: Column) -> Column:
    """Whether a path resolved against the root stays below it.

    ``a/../b`` is fine, ``../b`` and ``a/../../b`` are not: the running depth over the
    path's parts must never become negative.
    """
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["now"] + F.when(p == "..", -1).otherwise(1)).alias("now"),
            F.least(acc["low"], acc["now"] + F.when(p == "..", -1).otherwise(1)).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return ~path.startswith("/") & (depth >= 0)


def filename_parts(name: Column) -> list[Column]:
    """Four key fields of an upper-cased file stem; all NULL when it does not match."""
    from voxloom.schemas import FILENAME_PATTERN

    stem = F.upper(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""))
    names = ("actor", "sentence", "emotion", "intensity")
    return [
        F.when(stem.rlike(FILENAME_PATTERN), F.regexp_extract(stem, FILENAME_PATTERN, i + 1)).alias(n)
        for i, n in enumerate(names)
    ]


def zero_padded(number: Column, width: int) -> Column:
    """The number in at least ``width`` digits; a longer one is never cut."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
