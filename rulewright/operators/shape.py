"""What a pattern's structure says: runaway loops, the cost of a try, literals of every match.

A pattern is cut into items (a character, class, escape or bracket, with its repeat), and
one ``aggregate`` walks over them with the open groups on a stack, which is an array.  All
of it is row-local and inside Spark's expressions.

* A *loop* is a repeat without an upper bound that gives characters back.  An alternative
  is *loose* if it ends in a loop that at most optional items follow.  A loop around a
  group with a loose alternative can share characters between rounds in exponentially
  many ways, however deep the inner loop lies; so can one around alternatives that begin alike.
* Loops in a row, without an item between them that must match, share characters too:
  a failing try takes up to length ** (longest row + 1) steps, one power more if there
  are other loops.
* An item that must match and can only be one of a few characters, or a run of literal
  characters, is part of every match.  Groups of several alternatives give the union of
  what the alternatives give, as long as each gives something.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REPEAT = r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?"
_ESCAPE = (
    r"\\Q[\s\S]*?(?:\\E|$)|\\[pPN]\{[^}]*\}|\\x\{[^}]*\}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\k<[^>]*>|\\0[0-7]{1,3}|\\c.|\\[pP].|\\[\s\S]"
)
_CLASS = r"\[\^?\]?(?:\\[\s\S]|[^\[\]\\]|\[[^\[\]]*\])*\]"
_ATOM = rf"(?:{_ESCAPE}|{_CLASS}|[^()|])"
_OPEN = r"\((?:\?(?:<[A-Za-z][A-Za-z0-9]*>|<[=!]|[:=!>]|[A-Za-z-]+[:)]))?"
ITEM = rf"{_ATOM}(?:{_REPEAT})?|\)(?:{_REPEAT})?|{_OPEN}|\|"
_PARTS = rf"^({_ATOM}|\))({_REPEAT})?$"
_CLASS_PIECE = r"\\d|(?:\\[^A-Za-z0-9]|[^\\])-(?:\\[^A-Za-z0-9]|[^\\])|\\[^A-Za-z0-9]|[^\\]"
_PLAIN_CLASS = r"^\[(?!\^)(?:\\d|\\[^A-Za-z0-9]|[^\\\[\]&])+\]$"

#: Most characters that an item may stand for to be a hint.
MEMBERS = 64
#: Sets that an alternative passes on.
RANKS = 4
#: Steps that a try of an example may take.
STEPS = 1e8

# The walk is written as SQL text: as Python columns its many small parts take seconds to put together.
SETS = "array<array<string>>"
LEVEL = ("kind", "loose", "blank", "any_loose", "any_blank", "fresh", "firsts", "run", "sets", "others")
STATE = ("top", "below", "found", "loops", "row", "longest", "placed", "flags")


def _raw(regex: str) -> str:
    return f"r'{regex}'"


def _empty(kind: str) -> str:
    return f"CAST(array() AS {kind})"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields.items()) + ")"


def _with(struct: str, names: Sequence[str], **changed: str) -> str:
    """``struct`` with some fields changed."""
    return _struct({n: changed.get(n, f"{struct}.{n}") for n in names})


def _level(kind: str) -> str:
    values = (kind, "false", "true", "false", "false", "true", _empty("array<string>"), "''", _empty(SETS), _empty(f"array<{SETS}>"))
    return _struct(dict(zip(LEVEL, values)))


def _let(value: str, name: str, inside: str) -> str:
    """``inside``, which may use ``name`` for ``value``."""
    return f"transform(array({value}), {name} -> {inside})[0]"


def _bare(text: str) -> str:
    return f"regexp_replace({text}, {_raw('^' + chr(92) * 2)}, '')"


def _members(body: str) -> str:
    """The characters that an item stands for; NULL where they are many or not plain to see."""
    digits = "array(" + ", ".join(f"'{d}'" for d in "0123456789") + ")"
    low, high = f"ascii({_bare('p')})", f"ascii({_bare('regexp_extract(p, ' + _raw(r'-(\\?[^\\])$') + ', 1)')})"
    spread = f"CASE WHEN {high} < 128 AND {high} >= {low} THEN transform(sequence({low}, greatest({low}, least({high}, 127))), c -> chr(c)) END"
    piece = f"CASE WHEN p = {_raw(r'\d')} THEN {digits} WHEN p RLIKE {_raw(r'^\\?[^\\]-\\?[^\\]$')} THEN {spread} ELSE array({_bare('p')}) END"
    pieces = f"transform(regexp_extract_all(substring({body}, 2, length({body}) - 2), {_raw(_CLASS_PIECE)}, 0), p -> {piece})"
    named = _let(pieces, "ps", "CASE WHEN NOT exists(ps, p -> p IS NULL) THEN array_distinct(flatten(ps)) END")
    found = f"""CASE WHEN {body} RLIKE {_raw(r'^\\Q')}
      THEN array(regexp_replace(substring({body}, 3), {_raw(r'\\E$')}, ''))
      WHEN {body} RLIKE {_raw(r'^\\[^A-Za-z0-9]$')} THEN array({_bare(body)})
      WHEN length({body}) = 1 AND {body} NOT IN ('.', '^', '$') THEN array({body})
      WHEN {body} = {_raw(r'\d')} THEN {digits}
      WHEN {body} RLIKE {_raw(_PLAIN_CLASS)} THEN {named} END"""
    return _let(found, "m", f"CASE WHEN size(m) <= {MEMBERS} THEN m END")


def _item(text: str) -> str:
    """kind (open, close, or, flags, atom), body, and what its repeat allows."""
    kind = f"""CASE WHEN {text} = '|' THEN 'or' WHEN {text} RLIKE {_raw(r'^\(\?[A-Za-z-]+\)$')} THEN 'flags'
      WHEN startswith({text}, '(') THEN 'open' WHEN startswith({text}, ')') THEN 'close' ELSE 'atom' END"""
    fields = {
        "kind": kind,
        "body": "body",
        "optional": f"again RLIKE {_raw(r'^(?:[?*]|\{0+[,}])')}",
        "loop": f"again RLIKE {_raw(r'^(?:[*+]|\{\d+,\})')} AND NOT (length(again) > 1 AND endswith(again, '+'))",
        "once": "again = ''",
        "edge": f"body RLIKE {_raw(r'^(?:[\^$]|\\[bBAzZG])$')}",
        "reference": f"body RLIKE {_raw(r'^\\(?:[1-9]|k<)')}",
        "members": f"CASE WHEN {text} NOT RLIKE {_raw(r'^[()|]')} THEN {_members('body')} END",
    }
    parts = lambda k: f"regexp_extract({text}, {_raw(_PARTS)}, {k})"
    return _let(f"coalesce(nullif({parts(1)}, ''), {text})", "body", _let(parts(2), "again", _struct(fields)))


def _flushed(level: str) -> str:
    """The sets of the alternative with its run of literals."""
    return f"CASE WHEN {level}.run <> '' THEN concat({level}.sets, array(array({level}.run))) ELSE {level}.sets END"


def _ranked(sets: str) -> str:
    """The distinct sets, those of fewest members first, of equals those with the longest first member."""
    each = f"transform({sets}, s -> named_struct('n', size(s), 'l', -length(s[0]), 's', s))"
    return f"transform(slice(array_sort(array_distinct({each})), 1, {RANKS}), x -> x.s)"


def _given(level: str) -> str:
    """The sets that a group, or the whole pattern, gives.

    Of alternatives the sets of equal rank are united, as long as each alternative has one.
    """
    union = """transform(sequence(1, array_max(transform(every, e -> size(e)))),
      k -> array_distinct(flatten(transform(every, e -> element_at(e, least(k, size(e)))))))"""
    several = f"CASE WHEN exists(every, e -> size(e) = 0) THEN {_empty(SETS)} ELSE {union} END"
    united = _let(f"concat({level}.others, array({_ranked('flushed')}))", "every", several)
    return _let(_flushed(level), "flushed", f"CASE WHEN size({level}.others) = 0 THEN flushed ELSE {united} END")


def _step(state: str, item: str) -> str:
    top = f"{state}.top"

    # An item on its own.
    literal = f"(NOT {item}.optional AND {item}.once AND size({item}.members) = 1)"
    atom = _with(
        top, LEVEL,
        loose=f"{item}.loop OR ({item}.optional AND {top}.loose)",
        blank=f"{top}.blank AND {item}.optional",
        fresh="false",
        firsts=f"CASE WHEN {top}.fresh THEN concat({top}.firsts, array({item}.body)) ELSE {top}.firsts END",
        run=f"CASE WHEN {literal} THEN concat({top}.run, {item}.members[0]) ELSE '' END",
        sets=f"""CASE WHEN {literal} THEN {top}.sets WHEN NOT {item}.optional AND {item}.members IS NOT NULL
          THEN concat({_flushed(top)}, array({item}.members)) ELSE {_flushed(top)} END""",
    )
    row = f"CASE WHEN {item}.loop THEN {state}.row + 1 WHEN {item}.optional OR {item}.edge THEN {state}.row ELSE 0 END"
    with_atom = _with(
        state, STATE, top=f"CASE WHEN {item}.edge THEN {top} ELSE {atom} END", loops=f"{state}.loops + CAST({item}.loop AS INT)",
        row=row, longest=f"greatest({state}.longest, {row})", placed=f"{state}.placed AND NOT {item}.reference",
    )

    # A group's end: what it says about the level below it.
    around = f"{top}.kind RLIKE {_raw(r'^\(\?<?[=!]')}"  # looks around, takes nothing
    whole = f"{top}.kind = '(?>'"  # gives nothing back
    loose = f"(({top}.loose OR {top}.any_loose) AND NOT {around} AND NOT {whole})"
    skip = f"({item}.optional OR {top}.blank OR {top}.any_blank OR {around})"
    alike = f"""(size({top}.others) > 0 AND NOT {whole}
      AND (size(array_distinct({top}.firsts)) < size({top}.firsts) OR array_contains({top}.firsts, '.')))"""
    closed = _with(
        "under", LEVEL,
        loose=f"{item}.loop OR {loose} OR ({skip} AND under.loose)",
        blank=f"under.blank AND {skip}",
        fresh="false",
        # A group's beginning is not followed: it is like no other.
        firsts="CASE WHEN under.fresh THEN concat(under.firsts, array(concat('(', size(under.others)))) ELSE under.firsts END",
        run="''",
        sets=f"CASE WHEN {item}.optional OR {around} THEN {_flushed('under')} ELSE concat({_flushed('under')}, {_given(top)}) END",
    )
    with_close = _with(
        state, STATE, top=_let(f"element_at({state}.below, -1)", "under", closed), below=f"slice({state}.below, 1, size({state}.below) - 1)",
        found=f"""coalesce({state}.found, CASE WHEN {item}.loop AND {loose} THEN 'runaway:loose-end'
          WHEN {item}.loop AND {alike} THEN 'runaway:overlapping-choice' END)""",
        loops=f"{state}.loops + CAST({item}.loop AS INT)", row=f"{state}.row + CAST({item}.loop AS INT)",
        longest=f"greatest({state}.longest, {state}.row + CAST({item}.loop AS INT))",
    )

    with_open = _with(state, STATE, top=_level(f"{item}.body"), below=f"concat({state}.below, array({top}))")
    other = _with(
        top, LEVEL, loose="false", blank="true", fresh="true", run="''", sets=_empty(SETS),
        any_loose=f"{top}.any_loose OR {top}.loose", any_blank=f"{top}.any_blank OR {top}.blank",
        others=f"concat({top}.others, array({_ranked(_flushed(top))}))",
    )
    with_or = _with(state, STATE, top=other, row="0")
    with_flags = _with(state, STATE, flags=f"concat({state}.flags, {item}.body)")
    return f"""CASE {item}.kind WHEN 'open' THEN {with_open} WHEN 'or' THEN {with_or} WHEN 'flags' THEN {with_flags}
      ELSE CASE WHEN {item}.kind = 'close' AND size({state}.below) > 0 THEN {with_close} ELSE {with_atom} END END"""


def pattern_shape(pattern: str) -> Column:
    """What the column ``pattern`` says by its structure: reason (a runaway code or NULL), loops, degree of
    the steps of a try (NULL if it cannot be told, as with references), sets (each: every match
    holds one of its members), hint (the best of them)."""
    name = "`" + pattern.replace("`", "``") + "`"
    items = f"transform(regexp_extract_all({name}, {_raw(ITEM)}, 0), t -> {_item('t')})"
    start = dict(zip(STATE, (_level("''"), f"slice(array({_level(chr(39) * 2)}), 1, 0)", "CAST(NULL AS STRING)", "0", "0", "0", "true", "''")))
    switched = f"(state.flags <> '' OR {name} RLIKE {_raw(r'\(\?[A-Za-z-]+:')})"
    told = f"state.placed AND NOT {name} RLIKE {_raw(r'\(\?[A-Za-z-]*x')}"
    end = _let(
        f"CASE WHEN {switched} THEN {_empty(SETS)} ELSE {_given('state.top')} END", "sets",
        _struct({
            "reason": "state.found", "loops": "state.loops", "degree": f"CASE WHEN {told} THEN state.longest + 1 + CAST(state.loops > 1 AS INT) END",
            "sets": "sets", "hint": f"try_element_at({_ranked('sets')}, 1)",
        }),
    )
    return F.expr(f"aggregate({items}, {_struct(start)}, (state, item) -> {_step('state', 'item')}, state -> {end})")


def holds(shape: Column, literals: Column) -> Column:
    """True where every match of the pattern is known to hold one of ``literals``."""
    return F.exists(shape["sets"], lambda s: F.forall(s, lambda text: F.exists(literals, lambda r: text.contains(r))))


def can_try(shape: Column, text: Column) -> Column:
    """True where a try of the pattern on ``text`` takes at most ``STEPS`` steps, or 2 ** length if nothing is known."""
    length = F.length(text).cast("double") + 1
    return F.coalesce(F.pow(length, shape["degree"]), F.pow(F.lit(2.0), length)) <= STEPS


def needs_shape(pattern: Column, longest: Column) -> Column:
    """False where a look at single characters shows that a try on texts of up to ``longest`` characters
    ends soon and that no repeated group is there."""
    repeats = F.regexp_count(pattern, F.lit(r"[*+{]"))
    steps = F.pow(F.coalesce(longest, F.lit(0)).cast("double") + 1, repeats + 2)
    return pattern.rlike(r"\)[*+{]|\\[1-9k]|\(\?[A-Za-z-]*x") | ((repeats > 0) & (steps > STEPS))


def derive_hints(rules: DataFrame) -> DataFrame:
    """``rules`` whose empty ``requires`` is filled with what the pattern itself says; still empty if it says nothing."""
    given = F.coalesce("requires", F.array().cast("array<string>")) if "requires" in rules.columns else F.array().cast("array<string>")
    hint = F.coalesce(pattern_shape("pattern")["hint"], F.array().cast("array<string>"))
    return rules.withColumn("requires", F.when(F.size(given) > 0, given).otherwise(hint))
