"""Secret scans in column expressions: three patterns, and entropy.

The entropy method looks at candidate strings (runs of 20 or more characters
of ``[A-Za-z0-9+/_=-]``). A window of ``WINDOW`` characters slides over a
candidate, which is split into codes once; one count goes up, one goes down
(counts are five bits each in a few longs), and the sum of ``c * log2(c)``
follows them, so each step is constant work; after the first window that reaches
the threshold nothing more is counted. A candidate of hexadecimal digits and one
of mixed characters, the two classes of keys, have their own thresholds. Candidates of the
allow-list (no digit, no letter, UUIDs, paths and chains of words, long runs of
the alphabet, placeholders) and those that meet a span of a pattern are
suppressed. A path or a chain with one piece that isn't a word, such as
``KEY_NAME=`` before a key, is measured whole.

The SQL suppresses every path and chain: it differs from the query where one
holds a piece that isn't a word and a window reaches the threshold.

Places of all matches come from the pieces between them (``split``), so they
count code points. Matches are gone through in blocks, so work is in proportion
to a text's length and matches, however many.

Edge cases: a null or empty text has no spans; spans of one start are in the
order of ``KINDS``; rows that repeat each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.llm.common import pick

KINDS = ("assign", "access", "hex", "entropy")
_VALUE = "[A-Za-z0-9+/_.=-]+"
_NAME = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_LEAD = rf"(?:{_NAME})[\"']?\x20*[:=]\x20*[\"']?"
#: Patterns and the least length of what is measured. The runs of access and hex
#: are whole whether or not their least length is in the pattern, so it is there.
ASSIGN, ASSIGN_LEAST = f"{_LEAD}{_VALUE}", 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window must reach, for hexadecimal and for mixed candidates.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: A piece between separators that reads as a word or a number, or a whole UUID.
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_NAME_OR_NUMBER = "[A-Z]?[a-z]{0,15}(?:[A-Z][a-z]{1,15}){0,3}[0-9]{0,4}|[A-Z]{1,15}[0-9]{0,4}|[0-9]*"
_WORD, _PIECE = f"(?>(?:{_UUID}|{_NAME_OR_NUMBER})(?![A-Za-z0-9]))", f"^(?:{_NAME_OR_NUMBER})$"
_PATH, _SEPARATED = "(/[^/]*){3}", "([-_=][A-Za-z0-9]*){4}"
_PLAIN = ("^[^0-9]*$", "^[^A-Za-z]*$", f"^{_UUID}$")
_PLACEHOLDER = "[eE][xX][aA][mM][pP][lL][eE]|abcdefgh|ABCDEFGH|01234567|xxxxxxxx|XXXXXXXX"
#: Candidates that are never secrets: a path or a chain of names only where every piece is a word.
ALLOW = (*_PLAIN, f"^(?=.*(?:{_PATH}|{_SEPARATED})){_WORD}(?:[-_=/+]{_WORD})*+$", _PLACEHOLDER)
#: The allow-list of the SQL, which takes every path and chain as harmless, whatever its pieces.
SQL_ALLOW = (*_PLAIN, _PATH, _SEPARATED, _PLACEHOLDER)
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


#: Counts in a long of the state, and bits of each: a window's counts are under 2**5.
_PER_LONG, _BITS = 12, 5
#: Matches of a text that are gone through together.
_BLOCK = 256
_SPAN = "struct<s:int,k:int,e:int,m:string>"


def _shifted(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def window_entropy(text: Column, enough: Column | None = None) -> Column:
    """The highest Shannon entropy of a window of a candidate, in bits a
    character, by counts that are updated at each step; where a window reaches
    ``enough``, the first such."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    # split leaves an empty string at the end.
    symbols = F.slice(F.split(text, "", -1), F.lit(1), F.length(text))
    codes = F.transform(symbols, lambda c: F.instr(F.lit(_SYMBOLS), c) - 1)

    def count(state: Column, code: Column) -> Column:
        packed = F.element_at(state["counts"], F.floor(code / _PER_LONG).cast("int") + 1)
        return _shifted("shiftrightunsigned", packed, code % _PER_LONG * _BITS).bitwiseAND(F.lit(31)).cast("int")

    def one(code: Column, j: Column) -> Column:
        """What a count of one is in the j-th long."""
        here = F.floor(code / _PER_LONG) == j
        return F.when(here, _shifted("shiftleft", F.lit(1).cast("long"), code % _PER_LONG * _BITS)).otherwise(F.lit(0).cast("long"))

    def step(codes: Column, state: Column, i: Column) -> Column:
        enter, leave = F.element_at(codes, i), F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))
        full = i > WINDOW
        up, down = count(state, enter), count(state, leave)
        gain = F.element_at(weight, up + 2) - F.element_at(weight, up + 1)
        loss = F.when(full, F.element_at(weight, down) - F.element_at(weight, down + 1)).otherwise(0.0)
        total = state["total"] + gain + loss
        counts = F.transform(
            state["counts"], lambda c, j: c + one(enter, j) - F.when(full, one(leave, j)).otherwise(F.lit(0).cast("long"))
        )
        bits = F.when(i >= WINDOW, math.log2(WINDOW) - total / WINDOW).otherwise(0.0)
        best = F.greatest(state["best"], bits)
        moved = F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"), state["enough"].alias("enough"))
        # The same symbol comes and goes: nothing changes.
        moved = F.when(full & (enter == leave), state).otherwise(moved)
        return F.when(state["best"] >= state["enough"], state).otherwise(moved)

    longs = F.array_repeat(F.lit(0).cast("long"), -(-len(_SYMBOLS) // _PER_LONG))
    enough = F.lit(math.inf) if enough is None else enough
    start = F.struct(longs.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), enough.alias("enough"))
    # transform names the codes, so that they are made once.
    best = F.transform(
        F.array(codes),
        lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x)), start, lambda s, i: step(x, s, i), lambda s: s["best"]),
    )
    return F.element_at(best, 1)


def _gone_through(items: Column, start: dict[str, Column], step) -> Column:
    """The spans that ``step(state, item)`` gives, in order: a dictionary of the
    next state, and an array of spans. ``items`` is a column, not an expression."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def block(state: Column, first: Column) -> Column:
        def one(now: Column, x: Column) -> Column:
            following, spans = step(now, x)
            fields = [v.alias(n) for n, v in following.items()]
            return F.struct(*fields, F.concat(now["out"], spans).alias("out"))

        begin = F.struct(*[state[n].alias(n) for n in start], none.alias("out"))
        return F.aggregate(F.slice(items, first, F.lit(_BLOCK)), begin, one)

    begin = F.struct(*[v.alias(n) for n, v in start.items()], none.alias("out"))
    blocks = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(_BLOCK)),
        F.struct(begin.alias("now"), F.expr(f"cast(array() as array<array<{_SPAN}>>)").alias("done")),
        lambda state, first: F.struct(
            block(state["now"], first).alias("now"), F.concat(state["done"], F.array(state["now"]["out"])).alias("done")
        ),
        lambda state: F.flatten(F.concat(state["done"], F.array(state["now"]["out"]))),
    )
    return F.when(F.size(items) > 0, blocks).otherwise(none)


def _pieces(text: Column, pattern: str) -> Column:
    """The matches (``m``), each with what stands before it (``g``); the last has no match."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(F.rlike(text, F.lit(pattern)), zipped).otherwise(F.expr("cast(array() as array<struct<g:string,m:string>>)"))


def _matches(pieces: Column, kind: int) -> Column:
    """Every match with its place: ``s, k, e`` and the string ``m``."""

    def step(state: Column, x: Column):
        begin = state["at"] + F.length(x["g"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(begin.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["m"].alias("m")))
        return {"at": end}, F.when(x["m"].isNotNull(), span).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))

    return _gone_through(pieces, {"at": F.lit(0)}, step)


def _apart(spans: Column) -> Column:
    """The candidates that meet no span of a pattern, of all spans in order: one
    waits until what begins after it is known to begin behind its end."""
    candidate = KINDS.index("entropy")
    none, nothing = F.expr(f"cast(array() as array<{_SPAN}>)"), F.expr(f"cast(null as {_SPAN})")

    def step(state: Column, x: Column):
        own = x["k"] == candidate
        wait = F.when(own & (state["end"] <= x["s"]), x).when(own, nothing).when(state["wait"]["e"] > x["s"], nothing)
        gone = state["wait"].isNotNull() & (own | (state["wait"]["e"] <= x["s"]))
        wait = wait.otherwise(F.when(gone, nothing).otherwise(state["wait"]))
        end = F.when(own, state["end"]).otherwise(F.greatest(state["end"], x["e"]))
        return {"end": end, "wait": wait}, F.when(gone, F.array(state["wait"])).otherwise(none)

    return _gone_through(spans, {"end": F.lit(0), "wait": nothing}, step)


def _suspicious(candidate: Column) -> Column:
    allowed = F.rlike(candidate, F.lit(_PLACEHOLDER))
    for pattern in _PLAIN:
        allowed = allowed | F.rlike(candidate, F.lit(pattern))
    # A path or chain of which every piece between separators is a word; a UUID counts as one.
    pieces = F.split(F.regexp_replace(candidate, f"(?<![A-Za-z0-9]){_UUID}(?![A-Za-z0-9])", "uuid"), "[-_=/+]", -1)
    chain = F.rlike(candidate, F.lit(_PATH)) | F.rlike(candidate, F.lit(_SEPARATED))
    allowed = allowed | (chain & F.forall(pieces, lambda x: F.rlike(x, F.lit(_PIECE))))
    least = F.when(F.rlike(candidate, F.lit("^[0-9a-fA-F]*$")), HEX_BITS).otherwise(MIXED_BITS)
    return ~allowed & (window_entropy(candidate, least) >= least)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")),
        ),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the three patterns, the digest of their spans, and
    all spans."""
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True))
    rows = rows.select("doc_id", *[_pieces(F.col("text"), p).alias(k) for k, p in patterns.items()])
    rows = rows.select("doc_id", *[_matches(F.col(k), i).alias(k) for i, k in enumerate(KINDS)])
    long_enough = lambda x: F.length(F.regexp_replace(x["m"], f"^{_LEAD}", "")) >= ASSIGN_LEAST
    rows = rows.withColumn("assign", F.filter("assign", long_enough))
    place = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    base = F.array_sort(F.transform(F.concat("assign", "access", "hex"), place))
    behind = F.expr(f"cast(array(struct(2147483647, 0, 2147483647, null)) as array<{_SPAN}>)")
    ordered = F.when(F.size("entropy") > 0, F.concat(F.array_sort(F.concat("assign", "access", "hex", "entropy")), behind))
    ordered = ordered.otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    rows = rows.select("doc_id", base.alias("base"), ordered.alias("ordered"), *counts)
    rows = rows.withColumn("found", F.filter(_apart(F.col("ordered")), lambda c: _suspicious(c["m"])))
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", F.transform("found", place))))
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _found_sql(name: str, pattern: str, kind: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{name} AS (SELECT rid, i, m, {kind} AS k,
    sum(length(g)) OVER (PARTITION BY rid ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT rid, unnest(regexp_extract_all(text, '{quoted}')) AS m, unnest(range(len(regexp_extract_all(text, '{quoted}')))) AS i,
      unnest(string_split_regex(text, '{quoted}')[:len(regexp_extract_all(text, '{quoted}'))]) AS g
    FROM docs WHERE regexp_matches(text, '{quoted}')))"""


_QUOTED_LEAD = _LEAD.replace("'", "''")
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{','.join(_found_sql(n, p, k) for n, p, k in (("a", ASSIGN, 0), ("c", ACCESS, 1), ("h", HEX, 2), ("d", CANDIDATE, 3)))},
base AS (SELECT rid, s, s + length(m) AS e, k FROM a WHERE length(regexp_replace(m, '^{_QUOTED_LEAD}', '')) >= {ASSIGN_LEAST}
  UNION ALL SELECT rid, s, s + length(m), k FROM c UNION ALL SELECT rid, s, s + length(m), k FROM h),
apart AS (SELECT rid, m, s, s + length(m) AS e, k FROM d WHERE NOT {' AND NOT '.join(f"regexp_matches(m, '{p}')" for p in SQL_ALLOW)}
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = d.rid AND b.s < d.s + length(d.m) AND d.s < b.e)),
scored AS (SELECT rid, s, e, k, m, list_max(list_transform(range(1, length(m) - {WINDOW - 2}),
    lambda i: list_aggregate(string_split(substr(m, i, {WINDOW}), ''), 'entropy'))) AS bits FROM apart),
spans AS (SELECT rid, s, e, k FROM base UNION ALL SELECT rid, s, e, k FROM scored
  WHERE bits >= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]*$') THEN {HEX_BITS} ELSE {MIXED_BITS} END),
named AS (SELECT *, [{', '.join(f"'{k}'" for k in KINDS)}][k + 1] || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS name FROM spans)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY s, k, e) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY s, k, e), '') AS spans
FROM docs LEFT JOIN named USING (rid) GROUP BY docs.rid, doc_id
"""
