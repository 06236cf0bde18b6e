"""Detection: text column -> spans, in native column expressions.

The idea is a *shadow* of the text: a string of the same length in which every claimed
character is overwritten. Detectors run in rank order on the shadow, so a later detector
sees what earlier ones left, exactly as if the text had been replaced step by step, and
positions never move. One claim is written as

    kept-prefix fillers, one character that names the detector, value fillers, tail fillers

with private-use characters, so the finished shadow alone tells all spans. A detector is a
single ``regexp_replace`` that brackets its matches; rows without a match stop there. A
row-level prefilter (literals and cheap shared conditions) lists the detectors worth
running, and one ``aggregate`` folds the shadow through that list. There is no shuffle, no
Python worker, and work is linear in the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.functions import words as w
from textveil.functions.checks import named_checks
from textveil.functions.detectors import KEYWORD, Detector
from textveil.functions.dialect import any_literal, any_word, java, may_start
from textveil.functions.languages import language_test
from textveil.functions.sql import all_of, any_of, bind, in_list, let, text

# Private-use characters. Input that holds any is detected on a copy where they are
# replaced one for one; values are always cut from the original text.
PRIVATE = "[-]"
RANK0 = 0xE000
MAX_DETECTORS = 4096
RANKS = "[-]"
OPEN, SEP, CLOSE = "", "", ""
FILL_PREFIX, FILL_VALUE, FILL_TAIL = "", "", ""

SPAN = "struct<rank:int,start:int,end:int,v_start:int,v_end:int,value:string>"

# Cheap conditions every match of certain detectors implies: (earlier condition, regex).
GATES = {
    "digit": (None, r"\d"),
    "quote": (None, r"[\"']"),
    "joint": (None, r"[-:]"),
    "digits5": ("digit", r"\d{2}[-.\s]?\d{3}"),
    "digits7": ("digit", r"\d(?:[-.\s()]*\d){6}"),
    "digits12": ("digit", r"\d{12}"),
    "digits13": ("digit", r"\d(?:[ -]*\d){12}"),
    "dashed_digits": ("digit", r"\d-\d"),
    "joined_digits": ("digit", r"\d[/.\-]\d"),
    "dotted_digits": ("digit", r"\d\.\d{1,3}\."),
    "hex_pairs": ("joint", r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    "hex8": ("joint", r"[0-9a-fA-F]{8}-"),
}

# Active detectors of one kind from which one pass for all of them is made, if that is wanted.
UNITE_FROM = 3

# So many at most run as one pass: they are the bits of a number.
UNITE_MOST = 62

# Rows of up to so many claims are decoded by looking from the start for each of them.
FEW_CLAIMS = 32

# Up to so many literals are looked for one by one, more in one pass of a regex.
FEW_LITERALS = 32

# The largest allowlist that is written into the expression itself.
INLINE_ALLOWLIST = 5_000


class Scanner:
    """Expressions for one ordered list of detectors.

    allow       exact matches to leave alone (a short list)
    allowed     name of an ``array<string>`` column with the row's own allowed matches,
                for allowlists too long to inline
    given, surnames   dictionaries of the person-name check
    unite       run detectors that differ in their keywords only as one, over the union of the
                keywords; pays where many of them are active in one row. Findings are the same
    """

    def __init__(
        self,
        detectors: Sequence[Detector],
        allow: Iterable[str] = (),
        allowed: str | None = None,
        unite: bool = False,
        given: Iterable[str] = w.GIVEN_NAMES,
        surnames: Iterable[str] = w.SURNAMES,
    ):
        self.detectors = list(detectors)
        if len(self.detectors) > MAX_DETECTORS:
            raise ValueError(f"at most {MAX_DETECTORS} detectors")
        self.allow = sorted(set(allow))
        if len(self.allow) > INLINE_ALLOWLIST:
            raise ValueError("allowlist too long to inline; pass it as a DataFrame")
        self.allowed = allowed
        self.unite = unite
        self.checks = named_checks(given, surnames)

    # -- pieces of SQL ------------------------------------------------------------------

    def _ranks(self, wanted) -> list[int]:
        return [k for k, d in enumerate(self.detectors) if wanted(d)]

    def _by_rank(self, cases: dict[int, str], otherwise: str, k: str = "k") -> str:
        """``CASE k WHEN ...``, with ranks that share an expression listed together."""
        shared: dict[str, list[int]] = {}
        for rank, expr in cases.items():
            shared.setdefault(expr, []).append(rank)
        if not shared:
            return otherwise
        whens = " ".join(
            f"WHEN {k} IN ({', '.join(map(str, ranks))}) THEN {expr}"
            for expr, ranks in shared.items()
        )
        return f"CASE {whens} ELSE {otherwise} END"

    def _bracket(self, rank: int, shadow: str) -> str:
        """Every match of one detector between marks, behind it its prefix and its value."""
        d = self.detectors[rank]
        prefix = f"${d.prefix}" if d.prefix else ""
        marked = f"{OPEN}$0{OPEN}{prefix}{OPEN}${d.value}{OPEN}"
        return f"regexp_replace({shadow}, {text(d.java_regex)}, '{marked}')"

    def _bracket_any(self, shadow: str, ranks: Iterable[int]) -> str:
        cases = " ".join(f"WHEN {k} THEN {self._bracket(k, shadow)}" for k in ranks)
        return f"CASE k {cases} ELSE {shadow} END"

    def _accept(self, flag: str | None) -> str:
        """Is the match of detector ``k`` a finding?"""
        terms = ["length(value) > 0", f"NOT (match rlike '{PRIVATE}')"]
        spared = []
        if self.allow:
            spared.append(in_list("match", self.allow))
        if self.allowed:
            spared.append(f"array_contains({self.allowed}, match)")
        if spared:
            exempt = self._ranks(lambda d: not d.allowable)
            unless = f"k IN ({', '.join(map(str, exempt))}) OR " if exempt else ""
            terms.append(f"({unless}NOT {any_of(spared)})")
        checked = {
            k: all_of(f"({self.checks.get(c, c)})" for c in d.check)
            for k, d in enumerate(self.detectors) if d.check
        }
        terms.append(self._by_rank(checked, "true"))
        if flag:
            terms.append(flag)
        return all_of(terms)

    def _claim(self, prefix: str, gap: str, flag: str | None = None) -> str:
        """What detector ``k`` makes of a ``match`` and its ``value``.

        ``a``, ``n`` and ``l`` are the lengths of prefix, value and match, ``w`` is ``gap``, how far from here
        the next match starts; ``k`` is null if the match is not a finding.
        """
        trimmed = {
            k: f"length(regexp_replace(value, {text(java(chr(92) + 's+$'))}, ''))"
            for k in self._ranks(lambda d: d.trim)
        }
        n = f"CASE WHEN k IS NOT NULL AND {self._accept(flag)} THEN {self._by_rank(trimmed, 'length(value)')} END"
        return bind("l", "length(match)", bind("n", n, (
            f"named_struct('k', CASE WHEN n IS NOT NULL THEN k END, 'a', length({prefix}), 'n', n, 'l', l,"
            f" 'value', substring(match, length({prefix}) + 1, n), 'w', {gap})")))

    def _settle(self, xs: str, found: str, match: str, rest: str) -> str:
        """State after the claims ``xs``, one for each four of the pieces ``ps`` behind the first.

        ``match`` and ``rest``, the text of match ``j`` and what follows it, are over ``ps``, ``x``, ``j``.
        Their lengths place the claims; where there are many, the shadow is left to tell.
        """
        marks = ", ".join(f"'{chr(RANK0 + k)}'" for k in range(len(self.detectors)))
        masked = (
            f"CASE WHEN x.k IS NULL THEN {match} ELSE concat(repeat('{FILL_PREFIX}', x.a), array({marks})[x.k],"
            f" repeat('{FILL_VALUE}', x.n - 1), repeat('{FILL_TAIL}', x.l - x.a - x.n)) END"
        )
        span = ("named_struct('rank', x.k, 'start', y.at, 'end', y.at + x.l, 'v_start', y.at + x.a,"
                " 'v_end', y.at + x.a + x.n, 'value', x.value)")
        placed = (
            f"aggregate(xs, named_struct('at', length(ps[0]), 'found', {found}), (y, x) -> named_struct('at', y.at + x.w,"
            f" 'found', CASE WHEN x.k IS NULL THEN y.found ELSE concat(y.found, array({span})) END), y -> y.found)"
        )
        return bind("xs", xs, (
            f"named_struct('t', CASE WHEN size(xs) = 1 THEN {bind('j', '0', bind('x', 'xs[0]', f'concat(ps[0], {masked}, {rest})'))}"
            f" ELSE concat(ps[0], array_join(transform(xs, (x, j) -> concat({masked}, {rest})), '')) END,"
            f" 'found', CASE WHEN size(xs) <= {FEW_CLAIMS} THEN {placed} END)"))

    def _rewrite(self, bracketed: str, state: str, flag: str | None = None) -> str:
        """State after detector ``k`` bracketed its matches. Marks alone make the text longer."""
        claim = bind("match", "ps[4 * j + 1]", bind("value", "ps[4 * j + 3]", self._claim(
            "ps[4 * j + 2]", "CASE WHEN 4 * j + 5 < size(ps) THEN l + length(ps[4 * j + 4]) ELSE l END", flag)))
        xs = f"transform(sequence(0, size(ps) div 4 - 1), j -> {claim})"
        settled = self._settle(xs, f"{state}.found", "ps[4 * j + 1]", "ps[4 * j + 4]")
        return (f"CASE WHEN octet_length({bracketed}) > octet_length({state}.t) THEN"
                f" {bind('ps', f"split({bracketed}, '{OPEN}')", settled)} ELSE {state} END")

    def _step(self, state: str, ranks: Iterable[int]) -> str:
        """Run detector ``k`` on a state: the shadow ``t`` and the claims ``found`` so far, null if they
        are to be read off the shadow."""
        return bind("r", self._bracket_any(f"{state}.t", ranks), self._rewrite("r", state))

    def _united(self, ranks: Sequence[int]) -> str:
        """Run detectors that differ in keywords only: one pass over the union of the keywords.

        Run one by one, each claims its own matches from the left. One pass gives the same if
        no match of any of them starts inside another one, which the number of places where a
        match starts tells, and if at each place the longest keyword belongs to the first
        active detector that has a keyword there. Other rows are run one by one.
        """
        owners: dict[str, set[int]] = {}
        for k in ranks:
            for x in self.detectors[k].keywords:
                owners.setdefault(x, set()).add(k)
        bits = {x: sum(1 << k - ranks[0] for k in ks) for x, ks in owners.items()}
        shared: dict[str, list[str]] = {}
        for x, own in bits.items():
            shorter = sum(1 << k - ranks[0] for k in set().union(
                *(o for y, o in owners.items() if y != x and x.startswith(y))) - owners[x])
            shared.setdefault(f"named_struct('own', {own}L, 'shorter', {shorter}L)", []).append(x)
        facts = "CASE " + " ".join(f"WHEN {in_list('w', xs)} THEN {fact}" for fact, xs in shared.items()) + " END"
        regex = java(self.detectors[ranks[0]].around.replace(KEYWORD, any_word(owners)))
        # in front of each place where a match starts: its prefix, value and keyword
        bracketed = f"regexp_replace(_shadow, {text(java(may_start(owners)) + '(?=' + regex + ')')}, '{OPEN}$1{OPEN}$3{OPEN}$2{OPEN}')"
        active = f"filter(_active, k -> k BETWEEN {ranks[0]} AND {ranks[-1]})"
        state = "named_struct('t', _shadow, 'found', _found)"
        plain = ("o IS NOT NULL AND length(ps[4 * j + 4]) >= length(match)"
                 " AND (o.shorter & on & CASE WHEN k IS NULL THEN -1L ELSE first - 1L END) = 0")
        claim = bind("match", "concat(ps[4 * j + 1], ps[4 * j + 2])", bind("value", "ps[4 * j + 2]", self._claim(
            "ps[4 * j + 1]", f"length(ps[4 * j + 4]), 'plain', {plain}")))
        # the lowest bit of the active detectors that have the keyword, and its number
        owner = f"CASE WHEN first <> 0 THEN {ranks[0]} + bit_count(first - 1L) END"
        claim = bind("w", "lower(ps[4 * j + 3])", bind("o", facts, bind(
            "first", "o.own & on & -(o.own & on)", bind("k", owner, claim))))
        settled = self._settle("qs", "_found", "substring(ps[4 * j + 4], 1, x.l)", "substring(ps[4 * j + 4], x.l + 1)")
        whole = bind("ps", f"split({bracketed}, '{OPEN}')", (
            f"CASE WHEN size(ps) = 1 THEN {state} ELSE "
            + bind("qs", f"transform(sequence(0, size(ps) div 4 - 1), j -> {claim})",
                   f"CASE WHEN forall(qs, q -> q.plain) THEN {settled} END") + " END"))
        alone = f"aggregate(act, {state}, (s, k) -> {self._step('s', ranks)})"
        on = f"aggregate(act, 0L, (b, k) -> b | shiftleft(1L, k - {ranks[0]}))"
        return bind("act", active, (
            f"CASE WHEN size(act) = 0 THEN {state} WHEN size(act) < {UNITE_FROM} THEN {alone}"
            f" ELSE coalesce({bind('on', on, whole)}, {alone}) END"))

    @staticmethod
    def cut(shadow: str) -> str:
        """The shadow cut by marks, claims in odd places; null without claims."""
        return (f"CASE WHEN {shadow} rlike '{RANKS}' THEN regexp_replace({shadow},"
                f" '({FILL_PREFIX}*)({RANKS}{FILL_VALUE}*)({FILL_TAIL}*)', '{OPEN}$1{SEP}$2{SEP}$3{OPEN}') END")

    @classmethod
    def decode(cls, shadow: str, cut: str) -> str:
        """Shadow -> ordered array of spans; values are cut from ``_original``, a name the
        caller binds, so that no lambda variable can hide a column of the same name."""
        # a claim adds two marks around it and two inside; marks in front of it are not counted
        span = let("s", f"length(substring_index({cut}, '{OPEN}', i)) - 2 * (i - 1)", let("f", f"split(p, '{SEP}', -1)", (
            f"named_struct('rank', ascii(f[1]) - {RANK0}, 'start', s, 'end', s + length(p) - 2, 'v_start', s + length(f[0]),"
            " 'v_end', s + length(f[0]) + length(f[1]), 'value', substring(_original, s + length(f[0]) + 1, length(f[1])))")))
        few = f"array_compact(transform(split({cut}, '{OPEN}', -1), (p, i) -> CASE WHEN i % 2 = 1 THEN {span} END))"
        return (
            f"CASE WHEN {cut} IS NULL THEN CAST(array() AS array<{SPAN}>)"
            f" WHEN length({cut}) - length({shadow}) <= {4 * FEW_CLAIMS} THEN {few}"
            f" ELSE {cls._decode_many(shadow)} END"
        )

    @staticmethod
    def _decode_many(shadow: str) -> str:
        bracket = (
            f"regexp_replace({shadow}, '({FILL_PREFIX}*)({RANKS}{FILL_VALUE}*)({FILL_TAIL}*)',"
            f" '{OPEN}$1{SEP}$2{SEP}$3{CLOSE}')"
        )
        sizes = (
            "named_struct('rank', ascii(f[1]) - " + str(RANK0) + ", 'a', length(f[0]),"
            " 'b', length(f[1]), 'c', length(f[2]),"
            " 'gap', length(p) - length(f[0]) - length(f[1]) - length(f[2]) - 3)"
        )
        pieces = (
            f"transform(split({bracket}, '{OPEN}'), (p, i) -> CASE WHEN i = 0 THEN"
            " named_struct('rank', -1, 'a', 0, 'b', 0, 'c', 0, 'gap', length(p)) ELSE "
            + let("f", f"split(substring_index(p, '{CLOSE}', 1), '{SEP}', -1)", sizes) + " END)"
        )
        span = (
            "named_struct('rank', x.rank, 'start', c.at + s, 'end', c.at + s + x.a + x.b + x.c,"
            " 'v_start', c.at + s + x.a, 'v_end', c.at + s + x.a + x.b,"
            " 'value', substring(c.cut, s + x.a + 1, x.b))"
        )
        # about sqrt(n) runs of sqrt(n) pieces, each with its place and its part of the text:
        # an array that grows, or a long text that is cut, n times would be quadratic
        size = "(t, x) -> t + x.a + x.b + x.c + x.gap"
        sums = (f"transform(sequence(0, CAST((size(ps) - 1) div w AS INT)), j ->"
                f" aggregate(slice(ps, j * w + 1, w), 0, {size}))")
        runs = "transform(rs, (r, j) -> " + let("b", "aggregate(slice(rs, 1, j), 0, (t, x) -> t + x)", (
            "named_struct('at', b, 'cut', substring(_original, b + 1, r))")) + ")"
        inside = f"aggregate(slice(ps, CAST(i - i % w AS INT) + 1, CAST(i % w AS INT)), 0, {size})"
        placed = let("c", "cs[CAST(i div w AS INT)]", let("s", inside, span))
        fold = let("ps", pieces, let("w", "CAST(ceil(sqrt(size(ps))) AS INT)", let("rs", sums, let("cs", runs, (
            f"filter(transform(ps, (x, i) -> {placed}), x -> x.rank >= 0)")))))
        return fold

    # -- DataFrame steps ----------------------------------------------------------------

    def _prepare(self, df: DataFrame, column: str) -> DataFrame:
        """Add the working copy, the shared conditions and ``_active``, the ranks to run."""
        keep = df.columns
        column = f"`{column}`"
        work = (f"CASE WHEN {column} rlike '{PRIVATE}' THEN"
                f" regexp_replace({column}, '{PRIVATE}', '�') ELSE {column} END")
        df = df.selectExpr("*", f"coalesce({work}, '') AS _work")
        used = {d.gate for d in self.detectors if d.gate}
        first = sorted({GATES[g][0] or g for g in used})
        then = sorted(used - set(first))
        look = [f"_work rlike {text(java(GATES[g][1]))} AS _g_{g}" for g in first]
        hits = self._literal_ranks()
        few = len(hits) <= FEW_LITERALS
        # a pass for many detectors finds by itself whose keywords are there: one is enough to try it
        one = self.unite and all(d.around for d in self.detectors)
        if hits and one:
            look.append(f"lower(_work) rlike {text(any_literal(hits))} AS _any")
        elif hits and few:
            look.append("lower(_work) AS _low")
        elif hits:
            # one pass over the text finds the literals of all detectors
            look.append(
                "array_distinct(regexp_extract_all(lower(_work),"
                f" {text(any_literal(hits))}, 1)) AS _hits"
            )
        if look:
            df = df.selectExpr("*", *look)
        if then:
            df = df.selectExpr("*", *[
                f"(_g_{GATES[g][0]} AND _work rlike {text(java(GATES[g][1]))}) AS _g_{g}"
                for g in then
            ])
        # a language is only looked for where one of its keywords stands
        spoken = sorted({x for d in self.detectors for x in d.languages})
        if spoken:
            df = df.selectExpr("*", *[
                f"({'_any' if hits and one else self._keyword_seen(x, hits)} AND {language_test(x, '_work')}) AS _l_{x}"
                for x in spoken
            ])
        conditions = {
            k: all_of(([f"_g_{d.gate}"] if d.gate else [])
                      + [any_of(f"_l_{x}" for x in d.languages)] * bool(d.languages))
            for k, d in enumerate(self.detectors) if d.gate or d.languages
        }
        always = ", ".join(map(str, self._ranks(lambda d: not d.literals)))
        ranks = f"CAST(array({always}) AS array<int>)"
        if hits and (one or few):
            seen = {k: "true" if not d.literals else "_any" if one else any_of(f"contains(_low, {text(x)})" for x in d.literals)
                    for k, d in enumerate(self.detectors)}
            ranks = "array_compact(array({}))".format(
                ", ".join(f"CASE WHEN {all_of([seen[k], conditions.pop(k, 'true')])} THEN {k} END" for k in seen))
        elif hits:
            table = f"from_json({text(json.dumps(hits, ensure_ascii=False))}, 'map<string,array<int>>')"
            ranks = (f"array_sort(array_distinct(concat({ranks},"
                     f" flatten(transform(_hits, h -> element_at({table}, h))))))")
        return df.selectExpr(
            *_quoted(keep), "_work",
            f"filter({ranks}, k -> {self._by_rank(conditions, 'true')}) AS _active",
        )

    def _keyword_seen(self, language: str, hits: dict[str, list[int]]) -> str:
        ranks = set(self._ranks(lambda d: language in d.languages))
        if len(hits) <= FEW_LITERALS:
            return any_of(f"contains(_low, {text(x)})" for k in sorted(ranks) for x in self.detectors[k].literals) if all(
                self.detectors[k].literals for k in ranks) else "true"
        if any(not self.detectors[k].literals for k in ranks):
            return "true"
        return "arrays_overlap(_hits, array({}))".format(
            ", ".join(text(x) for x, owners in hits.items() if ranks & set(owners)))

    def _literal_ranks(self) -> dict[str, list[int]]:
        """For each literal, the detectors it may start: its own and those of its prefixes.

        The scan reports the longest literal at a position, which implies the shorter ones.
        """
        owners: dict[str, set[int]] = {}
        for k, d in enumerate(self.detectors):
            for x in d.literals:
                owners.setdefault(x, set()).add(k)
        return {
            x: sorted(set().union(*(ks for y, ks in owners.items() if x.startswith(y))))
            for x in sorted(owners)
        }

    def shadow(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` plus ``_shadow`` and ``_found``, the claims (see :meth:`_step`): all detectors in rank
        order, earlier claims win."""
        df = self._prepare(df, column)
        keep = [c for c in df.columns if c not in ("_work", "_active")]
        df = df.selectExpr(*_quoted(keep), "_work AS _shadow", f"{self._none_found(column)} AS _found", "_active")
        for run in self._runs():
            if isinstance(run, int):
                df = self._python_step(df, keep, run)
                continue
            if isinstance(run, tuple):
                state = self._united(run)
            else:
                # the fold sees only the ranks of its own run, in order
                first, last = run[0], run[-1]
                ranks = ("_active" if len(run) == len(self.detectors) else
                         f"filter(_active, k -> k BETWEEN {first} AND {last})")
                before = "named_struct('t', _shadow, 'found', _found)"
                state = (f"CASE WHEN size(_active) = 0 THEN {before} ELSE"
                         f" aggregate({ranks}, {before}, (s, k) -> {self._step('s', run)}) END")
            df = self._next(df.selectExpr(*_quoted(keep), "_active", f"{state} AS _state"), keep)
        return df.drop("_active")

    @staticmethod
    def _none_found(column: str) -> str:
        """Claims before the first detector. Values are cut from the copy only where it is the text."""
        return f"CASE WHEN _work = coalesce(`{column}`, '') THEN CAST(array() AS array<{SPAN}>) END"

    @staticmethod
    def _next(df: DataFrame, keep: list[str]) -> DataFrame:
        return df.selectExpr(*_quoted(keep), "_active", "_state.t AS _shadow", "_state.found AS _found")

    def spans(
        self, df: DataFrame, column: str, into: str = "spans", leftover: str | None = None,
        leftover_into: str = "leftover",
    ) -> DataFrame:
        """``df`` plus the array of accepted, non-overlapping spans in text order.

        With ``leftover``, a regex, also its distinct matches in unclaimed text (or null).
        """
        shadowed = self.shadow(df, column)
        keep = [c for c in shadowed.columns if c not in ("_shadow", "_found")]
        extra = []
        if leftover:
            extra.append(f"CASE WHEN _shadow rlike {text(leftover)} THEN array_distinct("
                         f"regexp_extract_all(_shadow, {text(leftover)}, 0)) END AS {leftover_into}")
        cut = shadowed.selectExpr("*", f"`{column}` AS _original", f"CASE WHEN _found IS NULL THEN {self.cut('_shadow')} END AS _cut")
        return cut.selectExpr(*_quoted(keep), (
            f"CASE WHEN _found IS NULL THEN {self.decode('_shadow', '_cut')} WHEN size(_found) < 2 THEN _found"
            f" ELSE array_sort(_found, (x, y) -> x.start - y.start) END AS {into}"), *extra)

    def raw_spans(self, df: DataFrame, column: str, into: str = "spans") -> DataFrame:
        """``df`` plus every match of every detector on its own, overlaps included."""
        if any(d.python_check for d in self.detectors):
            raise ValueError("Python predicates need spans(), not raw_spans()")
        df = self._prepare(df, column)
        keep = [c for c in df.columns if c not in ("_work", "_active")]
        run = range(len(self.detectors))
        state = f"named_struct('t', _work, 'found', {self._none_found(column)})"
        states = f"transform(_active, k -> {bind('s', state, self._step('s', run))})"
        read = let("c", self.cut("z.t"), self.decode("z.t", "c"))
        found = f"flatten(transform({states}, z -> CASE WHEN z.found IS NULL THEN {read} ELSE z.found END))"
        df = df.selectExpr("*", f"`{column}` AS _original")
        return df.selectExpr(*_quoted(keep), f"{found} AS {into}")

    def _runs(self) -> list[list[int] | int | tuple[int, ...]]:
        """Consecutive ranks that run in one fold; a Python predicate stands alone, and detectors
        that run as one are a tuple."""
        runs: list[list[int] | int | tuple[int, ...]] = []
        for k, d in enumerate(self.detectors):
            if d.python_check:
                runs.append(k)
            elif self.unite and d.around:
                if runs and isinstance(runs[-1], tuple) and len(runs[-1]) < UNITE_MOST and (
                        self.detectors[runs[-1][0]].around == d.around):
                    runs[-1] += (k,)
                else:
                    runs.append((k,))
            elif runs and isinstance(runs[-1], list):
                runs[-1].append(k)
            else:
                runs.append([k])
        return runs

    def _python_step(self, df: DataFrame, keep: list[str], rank: int) -> DataFrame:
        """A detector whose predicate is Python: Arrow batches of candidate values only."""
        check = _arrow_check(self.detectors[rank].python_check)
        df = df.selectExpr(
            *_quoted(keep), "_active", "_shadow", "_found",
            f"CASE WHEN array_contains(_active, {rank}) THEN {self._bracket(rank, '_shadow')}"
            " ELSE _shadow END AS _r",
        )
        df = df.selectExpr("*", f"filter(split(_r, '{OPEN}'), (p, i) -> i % 4 = 3) AS _candidates")
        df = df.withColumn("_flags", check("_candidates"))
        state = bind("k", str(rank), bind("s", "named_struct('t', _shadow, 'found', _found)", self._rewrite("_r", "s", "_flags[j]")))
        return self._next(df.selectExpr(*_quoted(keep), "_active", f"{state} AS _state"), keep)


def _arrow_check(predicate):
    """Lift a predicate over a Series of values to arrays of values."""

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def check(lists):
        import pandas as pd

        sizes = lists.map(len)
        flat = pd.Series([v for row in lists for v in row], dtype=object)
        verdict = list(predicate(flat)) if len(flat) else []
        out, at = [], 0
        for n in sizes:
            out.append([bool(x) for x in verdict[at:at + n]])
            at += n
        return pd.Series(out)

    # Spark resolves the hints of the inner function at definition time.
    return check


def _quoted(columns: Iterable[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


# -- findings -------------------------------------------------------------------------------


def explode_spans(
    df: DataFrame, detectors: Sequence[Detector], key: Sequence[str], spans: str = "spans",
    match_in: str | None = None,
) -> DataFrame:
    """One row per span: keys, detector facts, positions (0-based code points) and value.

    With ``match_in``, a text column, also the whole ``match``.
    """
    if not detectors:
        detectors = [Detector("none", "none", "$^", "")]

    def fact(values) -> Column:
        items = ", ".join("NULL" if v is None else text(v) for v in values)
        return F.expr(f"CAST(array({items}) AS array<string>)[s.rank]")

    # explode() would add the filter size(spans) > 0 and push it below the detection, which
    # would run twice; the outer form adds none, and empty rows are dropped after it.
    extra = []
    carried = []
    if match_in:
        # cut from the text after the explosion: where nobody asks for the match, nothing is cut
        carried = [F.col(match_in).alias("_original")]
        extra = [F.expr("substring(_original, s.start + 1, s.end - s.start)").alias("match")]
    return (
        df.select(*key, *carried, F.explode_outer(spans).alias("s"))
        .where("s IS NOT NULL")
        .select(
            *key,
            F.col("s.rank").alias("rank"),
            fact([d.name for d in detectors]).alias("pattern"),
            fact([d.category for d in detectors]).alias("category"),
            fact([d.group for d in detectors]).alias("grp"),
            fact([d.confidence for d in detectors]).alias("confidence"),
            F.col("s.start").alias("start"), F.col("s.end").alias("end"),
            F.col("s.v_start").alias("v_start"), F.col("s.v_end").alias("v_end"),
            F.col("s.value").alias("value"), *extra,
        )
    )


def find_spans(
    df: DataFrame, column: str, detectors: Sequence[Detector], key: Sequence[str] = ("doc_id",),
    resolve: bool = False, **options,
) -> DataFrame:
    """All matches of the detectors as findings.

    Each detector looks at the whole text; with ``resolve`` they run in rank order and an
    earlier detector's claim hides the text from later ones.
    """
    scanner = Scanner(detectors, **options)
    narrow = df.select(*key, column)
    spans = scanner.spans(narrow, column) if resolve else scanner.raw_spans(narrow, column)
    return explode_spans(spans, scanner.detectors, key, match_in=column)


def resolve_overlaps(df: DataFrame, spans: str = "spans", into: str | None = None) -> DataFrame:
    """Keep, per row, each span that touches no span of an earlier rank (or start).

    For spans that come from elsewhere; :meth:`Scanner.spans` resolves while it detects.
    """
    return df.withColumn(into or spans, F.expr(
        f"array_sort(aggregate(array_sort({spans}, (a, b) -> CASE"
        " WHEN a.rank <> b.rank THEN a.rank - b.rank ELSE a.start - b.start END),"
        f" CAST(array() AS array<{SPAN}>), (kept, x) -> CASE"
        " WHEN exists(kept, y -> x.start < y.end AND y.start < x.end) THEN kept"
        " ELSE concat(kept, array(x)) END), (a, b) -> a.start - b.start)"
    ))
