"""The queries in DuckDB's SQL, written from the definitions: constants that follow from lists and mask come from the codecs."""

from __future__ import annotations

from sayplace.operators.cells import APERTURE, PENTAGONS, RESOLUTION, SLOTS
from sayplace.operators.feistel import Feistel
from sayplace.operators.measure import grid_corners
from sayplace.operators.pool import FREQUENCY_RANK, LENGTH_BUDGET
from sayplace.operators.mask import ELLIPSES, HEIGHT, SIDE, SOUTH, WEST, WIDTH
from sayplace.operators.spelling import LEAST, STRONG, SUFFIXES, PREFIXES, VARIANTS, WEAK
from sayplace.operators.vocabulary import CONSONANTS, KINDS, VOWELS
from sayplace.operators.text import TEENS, TENS, UNITS
from sayplace.plans.queries import LETTERS, RING, phrase, plane, world

_SYLLABLES = f"syllables as (select c || v as s from unnest(string_split('{' '.join(CONSONANTS)}', ' ')) a(c), unnest(string_split('{' '.join(VOWELS)}', ' ')) b(v))"


def _list(name: str, ending: str = "", size: int = 1296) -> str:
    return f"{name} as (select i, w || '{ending}' as w from (select row_number() over (order by a.s, b.s) - 1 as i, a.s || b.s as w from syllables a, syllables b) where i < {size})"


_WORDS = f"{_SYLLABLES}, {_list('words')}"
_KINDS = _SYLLABLES + "".join(f", {_list(kind, ending, size)}" for kind, (size, ending) in KINDS.items())
_INSIDE = " or ".join(f"(i - {ci}) * (i - {ci}) * {rj * rj} + (j - {cj}) * (j - {cj}) * {ri * ri} <= {ri * ri * rj * rj}" for ci, cj, ri, rj in ELLIPSES)
_MASK = f"mask as (select square, row_number() over (order by square) - 1 as rank from (select j * {WIDTH} + i as square from range({WIDTH}) a(i), range({HEIGHT}) b(j) where {_INSIDE}))"


def _sha(message: str, modulus: int, digits: int = 16) -> str:
    return f"(('0x' || substr(sha256(unhex({message})), 1, {digits}))::ubigint % {modulus})::bigint"


def _hex(value: str, width: int) -> str:
    return f"printf('%0{2 * width}x', {value})"


def _forward(f: Feistel, source: str, value: str, out: str, name: str) -> str:
    """CTEs of a permutation, one for each round; the last is called name."""
    steps = [f"{name}0 as (select *, {value} // {f.right} as l_, {value} % {f.right} as r_ from {source})"]
    for k in range(f.rounds):
        m = f.left if k % 2 == 0 else f.right
        mix = _sha(f"'{(f.key + bytes([k])).hex()}' || {_hex('r_', f.half_bytes)}", m, 2 * f.hash_bytes)
        steps.append(f"{name}{k + 1} as (select * exclude (l_, r_), r_ as l_, (l_ + {mix}) % {m} as r_ from {name}{k})")
    steps.append(f"{name} as (select * exclude (l_, r_), l_ * {f.right} + r_ as {out} from {name}{f.rounds})")
    return ", ".join(steps)


def _back(f: Feistel, source: str, value: str, out: str, name: str) -> str:
    steps = [f"{name}0 as (select *, {value} // {f.right} as l_, {value} % {f.right} as r_ from {source})"]
    for n, k in enumerate(reversed(range(f.rounds))):
        m = f.left if k % 2 == 0 else f.right
        mix = _sha(f"'{(f.key + bytes([k])).hex()}' || {_hex('l_', f.half_bytes)}", m, 2 * f.hash_bytes)
        steps.append(f"{name}{n + 1} as (select * exclude (l_, r_), ((r_ - {mix}) % {m} + {m}) % {m} as l_, l_ as r_ from {name}{n})")
    steps.append(f"{name} as (select * exclude (l_, r_), l_ * {f.right} + r_ as {out} from {name}{f.rounds})")
    return ", ".join(steps)


def _points(source: str, key: str, name: str = "points") -> str:
    return f"{name} as (select *, 50.0::double + ({key} * 7919 + 13) % 900001 / 100000.0::double as lat, -6.0::double + ({key} * 104729 + 7) % 750001 / 100000.0::double as lng from ({source}))"


_P = plane().grid.projection


def _cells(k: int, source: str = "points", name: str = "placed") -> str:
    """cell: of each point, null outside the mask."""
    return f"""{name}_a as (
        select *, sqrt(2.0 / (1.0 + {_P.sin!r} * sin(radians(lat)) + {_P.cos!r} * cos(radians(lat)) * cos(radians(lng) - radians({_P.lng})))) as k_ from {source}
    ), {name}_b as (
        select * exclude (k_), (6371008.8::double * k_ * cos(radians(lat)) * sin(radians(lng) - radians({_P.lng})) - {WEST}) / {SIDE} as fx,
               (6371008.8::double * k_ * ({_P.cos!r} * sin(radians(lat)) - {_P.sin!r} * cos(radians(lat)) * cos(radians(lng) - radians({_P.lng}))) - {SOUTH}) / {SIDE} as fy from {name}_a
    ), {name}_c as (select *, floor(fx)::bigint as i_, floor(fy)::bigint as j_ from {name}_b
    ), {name} as (
        select s.* exclude (i_, j_), (rank * {k} + least(trunc((fy - j_) * {k})::bigint, {k - 1})) * {k} + least(trunc((fx - i_) * {k})::bigint, {k - 1}) as cell
        from {name}_c s left join mask on i_ between 0 and {WIDTH - 1} and j_ between 0 and {HEIGHT - 1} and square = j_ * {WIDTH} + i_
    )"""


def _centres(k: int, source: str, cell: str, name: str, part: str = "") -> str:
    """to_lat, to_lng: the centre of each cell, or of its quarter where a part is given; null for null."""
    col = f"case when {part} is null then 0.5::double else ({part} % 2 + 0.5::double) / 2 end" if part else "0.5::double"
    row = f"case when {part} is null then 0.5::double else ({part} // 2 + 0.5::double) / 2 end" if part else "0.5::double"
    return f"""{name}_a as (
        select s.*, {WEST}::double + (square % {WIDTH}) * {SIDE}::double + ({cell} % {k} + {col}) * {SIDE / k!r}::double as x_, {SOUTH}::double + (square // {WIDTH}) * {SIDE}::double + ({cell} % {k * k} // {k} + {row}) * {SIDE / k!r}::double as y_
        from {source} s left join mask on rank = {cell} // {k * k}
    ), {name}_b as (select *, sqrt(x_ * x_ + y_ * y_) as rho, 2 * asin(sqrt(x_ * x_ + y_ * y_) / (2 * 6371008.8::double)) as c_ from {name}_a
    ), {name} as (
        select * exclude (x_, y_, rho, c_), degrees(asin(cos(c_) * {_P.sin!r} + y_ * sin(c_) * {_P.cos!r} / rho)) as to_lat,
               degrees(radians({_P.lng}) + atan2(x_ * sin(c_), rho * {_P.cos!r} * cos(c_) - y_ * {_P.sin!r} * sin(c_))) as to_lng from {name}_b
    )"""


_METRES = "2 * 6371008.8::double * asin(sqrt(pow(sin(radians(to_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(to_lat)) * pow(sin(radians(to_lng - lng) / 2), 2)))"


def _median(value: str, source: str) -> str:
    return f"(select {value} from (select {value}, row_number() over (order by {value}) - 1 as n, count(*) over () as total from {source} where {value} is not null) where n = total // 2)"


def _say(number: str, sizes: list[int], lists: list[str]) -> str:
    out, below = [], 1
    for size, name in reversed(list(zip(sizes, lists))):
        out.append(f"(select w from {name} where i = {number} // {below} % {size})")
        below *= size
    return " || '.' || ".join(reversed(out))


def _tokens(least: int = 4, most: int = 9) -> str:
    return f"tokens as (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) where length(word) between {least} and {most} group by word)"


def _stems(word: str, rules: list[tuple[str, str]]) -> str:
    """SQL list of the stems of a word by pairs of an ending and what is in its place, with doubled consonants undone."""
    found = []
    for a, b in rules:
        cond = f"ends_with({word}, '{a}') and length({word}) - {len(a)} + {len(b)} >= {LEAST}"
        stem = f"substr({word}, 1, length({word}) - {len(a)}) || '{b}'"
        found += [f"case when {cond} then {stem} end", f"case when {cond} and length({stem}) > {LEAST} and substr({stem}, -1) = substr({stem}, -2, 1) and substr({stem}, -1) not in ('a','e','i','o','u') then substr({stem}, 1, length({stem}) - 1) end"]
    return f"list_filter([{', '.join(found)}], lambda s: s is not null and s <> {word})"


def _variants(word: str) -> str:
    parts = []
    for a, b in VARIANTS:
        parts.append(f"list_transform(list_filter(range(1, length({word}) + 1), lambda p: substr({word}, p, {len(a)}) = '{a}'), lambda p: substr({word}, 1, p - 1) || '{b}' || substr({word}, p + {len(a)}))")
    return f"flatten([{', '.join(parts)}])"


def _said() -> str:
    """The nine forms of an address."""
    abc = "".join(f", (select w from words where i = o_orderkey * {p} % 1296) as {n}" for n, p in zip("abc", (1, 7, 11)))
    forms = [
        "a || '.' || b || '.' || c", "upper(a) || ', ' || b || ', ' || c", "'  ' || a || ' ' || b || ' ' || c || ' 07 '", "a || ' ' || b || ' ' || c || ' forty two'", "a || '/' || b || '/' || c || '/four/oh'", "' . '", "'seventeen'",
        "a || ' ' || b || ' ' || c || ' twelve three'", "a || '-ten-' || b || '-4-2'"]
    cases = " ".join(f"when {k} then {form}" for k, form in enumerate(forms))
    return f"{_WORDS}, spelled as (select o_orderkey{abc} from orders), typed as (select o_orderkey, case o_orderkey % {len(forms)} {cases} end as said from spelled)"


def _value(token: str, table: dict[str, int]) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in table.items())
    return f"(case {token} {cases} end)"


def _number() -> str:
    one = f"coalesce({', '.join(_value('run[1]', t) for t in (UNITS, TEENS, TENS))})"
    two = f"case when {_value('run[1]', TENS)} is not null and {_value('run[2]', UNITS)} > 0 then {_value('run[1]', TENS)} + {_value('run[2]', UNITS)} else {_value('run[1]', UNITS)} * 10 + {_value('run[2]', UNITS)} end"
    written = "len(list_filter(run, lambda t: not regexp_full_match(t, '[0-9]+'))) = 0"
    return f"case when len(run) = 0 then null when {written} then case when length(array_to_string(run, '')) <= 2 then array_to_string(run, '')::int end when len(run) = 1 then {one} when len(run) = 2 then {two} end"


def _inflected() -> str:
    """CTEs ending in inflected, rows (word), with the rule that a base under a weak ending is as frequent."""
    return (
        f"strong as (select word, unnest({_stems('word', STRONG)}) as base from tokens), weak as (select word, n, unnest({_stems('word', WEAK)}) as base from tokens), "
        "inflected as (select word from strong where base in (select word from tokens) union select w.word from weak w join tokens t on t.word = w.base and t.n >= w.n)")


def _with_variants() -> str:
    return f"others as (select word, unnest({_variants('word')}) as other from tokens), variant as (select distinct word from others where other <> word and length(other) >= {LEAST} and other in (select word from tokens))"


def _corner_lengths() -> str:
    """Ground lengths of the middle lines of a square about each corner."""
    corners = ", ".join(f"({k}, {x!r}::double, {y!r}::double)" for k, (x, y) in enumerate(grid_corners()))
    half = SIDE / 2
    return f"""corners as (select * from (values {corners}) v(corner, x, y)),
        ends as (select corner, e, x + dx as x, y + dy as y from corners, (values ('w', -{half}::double, 0::double), ('e', {half}::double, 0::double), ('s', 0::double, -{half}::double), ('n', 0::double, {half}::double)) d(e, dx, dy)),
        rho as (select *, sqrt(x * x + y * y) as r, 2 * asin(sqrt(x * x + y * y) / (2 * 6371008.8::double)) as c from ends),
        ground as (select corner, e, degrees(asin(cos(c) * {_P.sin!r} + y * sin(c) * {_P.cos!r} / r)) as lat, degrees(radians({_P.lng}) + atan2(x * sin(c), r * {_P.cos!r} * cos(c) - y * {_P.sin!r} * sin(c))) as lng from rho),
        wide as (select corner, max(case when e = 'w' then lat end) as lat, max(case when e = 'w' then lng end) as lng, max(case when e = 'e' then lat end) as to_lat, max(case when e = 'e' then lng end) as to_lng from ground group by corner),
        tall as (select corner, max(case when e = 's' then lat end) as lat, max(case when e = 's' then lng end) as lng, max(case when e = 'n' then lat end) as to_lat, max(case when e = 'n' then lng end) as to_lng from ground group by corner)"""


def oracles() -> dict[str, str]:
    u, p, g = plane(), phrase(), world()
    k, kp = u.k, p.k
    orders = _points("select o_orderkey from orders", "o_orderkey")
    uk = f"{_WORDS}, {_MASK}, {orders}, {_cells(k)}, {_forward(u.scramble, 'placed', 'cell', 'number', 'f')}"
    three = _say("number", [1296] * 3, ["words"] * 3)
    fives = _say("number", [1296] * 5, ["words"] * 5)
    cell_id = f"{(1 << 59) | (RESOLUTION << 52) | 7} | ((ordinal // {APERTURE ** RESOLUTION}) << 45)" + "".join(f" | ((ordinal // {APERTURE ** (RESOLUTION - r)} % 7) << {3 * (15 - r)})" for r in range(1, RESOLUTION + 1))
    first = "coalesce(" + ", ".join(f"nullif((cell >> {3 * (15 - r)}) & 7, 0)" for r in range(1, RESOLUTION + 1)) + ", 0)"
    valid = f"not (((cell >> 45) & 127) in ({', '.join(map(str, PENTAGONS))}) and {first} = 1)"
    world_cells = f"keyed as (select o_orderkey, ((o_orderkey::hugeint * 1000003000037 + 17) % {SLOTS})::bigint as ordinal from orders), celled as (select *, {cell_id} as cell from keyed)"
    part = f"least(trunc((fy * {k} - floor(fy * {k})) * 2)::bigint, 1) * 2 + least(trunc((fx * {k} - floor(fx * {k})) * 2)::bigint, 1)"
    with_number = f"numbered as (select *, part * 25 + {_sha(f'''{repr(b'ukd'.hex())} || {_hex('cell', 8)} || {_hex('part', 1)}''', 25)} as digits from (select *, {part} as part from f where cell is not null))"
    phrase_number = f"{_KINDS}, {_MASK}, {orders}, {_cells(kp)}, valued as (select *, cell * {p.check} + {_sha(f'''{repr(b'ukp-check'.hex())} || {_hex('cell', 8)}''', p.check)} as value from placed), {_forward(p.scramble, 'valued', 'value', 'number', 'f')}"
    neighbours = ", ".join([
        f"pairs as (select o_orderkey, o_orderkey * 104729 % {u.count - 1} as here, o_orderkey * 104729 % {u.count - 1} + 1 as there from orders)", _forward(u.scramble, "pairs", "here", "a", "fa"), _forward(u.scramble, "fa", "there", "b", "fb")])

    def mutate(radices: list[int]) -> str:
        """The number after one digit is moved on within its list."""
        slots, below = [], 1
        for n, radix in reversed(list(enumerate(radices))):
            digit = f"(number // {below} % {radix})"
            slots.append(f"case when o_orderkey % {len(radices)} = {n} then (({digit} + 1 + o_orderkey * 31 % {radix - 1}) % {radix} - {digit}) * {below} else 0 end")
            below *= radix
        return f"number + {' + '.join(slots)}"

    def refusals(status: str, source: str) -> str:
        return f"tried as (select *, {status} as status from {source}), far as (select *, round({_METRES} / 1000, 3) as km from tried)"

    uk_wrong = f"{uk}, wrong as (select *, {mutate([1296] * 3)} as said from f where cell is not null), {_back(u.scramble, 'wrong', 'said', 'found', 'b')}, landed as (select *, case when found < {u.count} then found end as to_cell from b), {_centres(k, 'landed', 'to_cell', 'centred')}"
    counted = f"select count(*) as trials, count(*) filter (where status <> 'ok') as refused, count(*) filter (where km < 1) as within_1_km, round({_median('km', 'far')}, 2) as median_km from far"
    phrase_sizes = [len(v) for v in p.slots]
    phrase_check = _sha(f"{repr(b'ukp-check'.hex())} || {_hex(f'(found // {p.check})', 8)}", p.check)
    phrase_wrong = f"{phrase_number}, wrong as (select *, {mutate(phrase_sizes)} as said from f where cell is not null), {_back(p.scramble, 'wrong', 'said', 'found', 'b')}, landed as (select *, case when found < {p.used} and {phrase_check} = found % {p.check} then found // {p.check} end as to_cell from b), {_centres(kp, 'landed', 'to_cell', 'centred')}"
    vowels = "".join(c for c, ph in LETTERS.items() if ph in "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split())
    back_status = f"case when found >= {g.used} then 'no_such_address' when not ({valid}) then 'no_such_cell' when {_sha(_hex('cell', 8), g.check)} <> found % {g.check} then 'check_failed' else 'ok' end"
    known = ", ".join(f"'{w}'" for w in (*UNITS, *TEENS, *TENS))
    parsed = rf"""{_said()}, cut as (select o_orderkey, list_filter(regexp_split_to_array(lower(trim(said)), '[\s.,;:/-]+'), lambda t: t <> '') as tokens from typed),
        ended as (select *, coalesce(list_max(list_transform(tokens, lambda t, i: case when regexp_full_match(t, '[0-9]+') or t in ({known}) then 0 else i end)), 0) as e from cut),
        runs as (select *, tokens[e + 1:] as run from ended), numbers as (select *, {_number()} as number from runs),
        judged as (select *, case when len(tokens) = 0 then 'empty' when e = 0 then 'no_words' when len(run) > 0 and number is null then 'bad_number' else 'ok' end as status from numbers)"""
    tried = "case o_orderkey % 4 when 0 then digits when 1 then null when 2 then (digits + 1) % 100 else 100 end"

    def fits(cell: str, number: str) -> str:
        message = f"'{b'ukd'.hex()}' || {_hex(cell, 8)} || {_hex(f'({number} // 25)', 1)}"
        return f"{_sha(message, 25)} = {number} % 25"

    with_tried = f"{uk}, {with_number}, asked as (select *, ({tried})::bigint as tried from numbered), told as (select * exclude (part), case when tried is null then 'ok' when tried > 99 then 'number_range' when {fits('cell', 'least(tried, 99)')} then 'ok' else 'number_mismatch' end as status, case when tried <= 99 then tried // 25 end as part from asked)"
    number_wrong = f"{uk}, {with_number}, wrong as (select *, {mutate([1296] * 3)} as said from numbered), {_back(u.scramble, 'wrong', 'said', 'found', 'b')}, landed as (select *, case when found < {u.count} and {fits('found', 'digits')} then found end as to_cell from b), {_centres(k, 'landed', 'to_cell', 'centred', 'part')}"
    sides = ", ".join(f"({x0}::double, {y0}::double, {x1}::double, {y1}::double)" for (x0, y0), (x1, y1) in zip(RING, RING[1:] + RING[:1]))
    refused = "case when to_cell is null then 'refused' else 'ok' end"
    return {
        "parse_addresses": f"with {parsed} select o_orderkey, case when status = 'ok' then array_to_string(tokens[:e], ' ') end as words, case when status = 'ok' then number end::bigint as number, status from judged",
        "parse_words": f"with {_said()}, cut as (select o_orderkey, list_filter(string_split(translate(lower(trim(said)), ', ', '..'), '.'), lambda t: t <> '') as w from typed) select o_orderkey, case when len(w) > 0 then array_to_string(w, ' ') end as words, case when len(w) > 0 then 'ok' else 'empty' end as status from cut",
        "uk_decode_with": f"with {with_tried}, {_centres(k, 'told', 'cell', 'centred', 'part')} select o_orderkey, tried, status, case when status = 'ok' then round(to_lat, 6) end as to_lat, case when status = 'ok' then round(to_lng, 6) end as to_lng from centred",
        "uk_wrong_word_with_number": f"with {number_wrong}, {refusals(refused, 'centred')} {counted}",
        "scanline_fill": f"with sides as (select * from (values {sides}) s(x0, y0, x1, y1)), samples as (select i, j, {WEST}::double + (i + 0.5::double) * {SIDE}::double as x, {SOUTH}::double + (j + 0.5::double) * {SIDE}::double as y from range({WIDTH}) a(i), range({HEIGHT}) b(j)), inside as (select i, j from samples, sides where (y0 <= y) <> (y1 <= y) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) < x group by i, j having count(*) % 2 = 1) select j, count(*) as samples, min(i) as first, max(i) as last from inside group by j",
        "uk_encode": f"with {uk} select o_orderkey, cell, case when cell is not null then {three} end as words, case when cell is null then 'outside' else 'ok' end as status from f",
        "uk_roundtrip_error": f"with {_MASK}, {orders}, {_cells(k)}, {_centres(k, '(select * from placed where cell is not null)', 'cell', 'centred')}, far as (select *, round({_METRES}, 6) as error from centred) select count(*) as points, count(*) as decoded, round(max(error), 4) as worst, round({_median('error', 'far')}, 4) as median_error from far",
        "uk_digits": f"with {uk}, {with_number} select o_orderkey, digits as number, {three} || ' ' || printf('%02d', digits) as address from numbered",
        "uk_outside_by_nation": f"with {_MASK}, {_points('select c_custkey, c_nationkey from customer', 'c_custkey')}, {_cells(k)} select n_name, count(*) as customers, count(*) filter (where cell is null) as outside from placed join nation on n_nationkey = c_nationkey group by n_nationkey, n_name",
        "uk_square_density": f"with {_MASK}, {_points('select l_orderkey * 8 + l_linenumber as key from lineitem', 'key')}, {_cells(k)} select cell // {k * k} as rank, count(*) as items from placed where cell is not null group by 1 order by items desc, rank limit 20",
        "uk_wrong_word": f"with {uk_wrong}, {refusals('''case when to_cell is null then 'no_such_address' else 'ok' end''', 'centred')} {counted}",
        "phrase_wrong_word": f"with {phrase_wrong}, {refusals('''case when to_cell is null then 'refused' else 'ok' end''', 'centred')} {counted}",
        "global_scramble": f"with keyed as (select o_orderkey, (o_orderkey::hugeint * 1000003000037 % {g.scramble.space})::bigint as value from orders), {_forward(g.scramble, 'keyed', 'value', 'number', 'f')}, {_back(g.scramble, 'f', 'number', 'back', 'b')} select o_orderkey, value, number, back from b",
        "global_words": f"with {_WORDS}, {world_cells}, valued as (select *, ordinal * {g.check} + {_sha(_hex('cell', 8), g.check)} as value from celled), {_forward(g.scramble, 'valued', 'value', 'number', 'f')} select o_orderkey, cell, {valid} as valid, {fives} as words from f",
        "global_decode_status": f"with {world_cells}, valued as (select * exclude (cell), ordinal * {g.check} + {_sha(_hex('cell', 8), g.check)} as value from celled), {_forward(g.scramble, 'valued', 'value', 'number', 'f')}, wrong as (select o_orderkey, {mutate([1296] * 5)} as said from f), {_back(g.scramble, 'wrong', 'said', 'found', 'b')}, again as (select *, found // {g.check} as ordinal from b), celled_again as (select *, {cell_id} as cell from again) select {back_status} as status, count(*) as n from celled_again group by 1",
        "phrase_encode": f"with {phrase_number} select o_orderkey, cell, case when cell is not null then {_say('number', phrase_sizes, list(p.pattern))} end as words, case when cell is null then 'outside' else 'ok' end as status from f",
        "neighbour_share": f"with {neighbours} select (a // 1679616 = b // 1679616)::int + (a // 1296 % 1296 = b // 1296 % 1296)::int + (a % 1296 = b % 1296)::int as shared, count(*) as n from fb group by 1",
        "collision_check": f"with {_MASK}, {orders}, {_cells(k)} select count(distinct cell) as cells, count(distinct cell) as addresses from placed",
        "numbers_fit": f"with keyed as (select c_custkey, c_custkey * 1299709 % {u.count} as cell, unnest(range(100)) as number from customer) select c_custkey, cell, string_agg(number::varchar, ',' order by number) as numbers from keyed where {_sha(f'''{repr(b'ukd'.hex())} || {_hex('cell', 8)} || {_hex('(number // 25)', 1)}''', 25)} = number % 25 group by all",
        "mask_decode": f"with {_MASK} select count(*) as squares, min(square) as first, max(square) as last from mask",
        "mask_runs": f"with flat as (select j * {WIDTH} + i as square, ({_INSIDE}) as inside from range({WIDTH}) a(i), range({HEIGHT}) b(j)), groups as (select inside, square - row_number() over (partition by inside order by square) as island, square from flat) select row_number() over (order by min(square)) - 1 as at, count(*) as run from groups group by inside, island",
        "mask_dilate": f"with {_MASK}, grown as (select distinct square % {WIDTH} + di as i, square // {WIDTH} + dj as j from mask, range(-1, 2) a(di), range(-1, 2) b(dj)) select count(*) as squares, sum(j * {WIDTH} + i)::bigint as total from grown where i between 1 and {WIDTH - 2} and j between 1 and {HEIGHT - 2}",
        "token_frequency_rank": f"with {_tokens()}, ranked as (select *, row_number() over (order by n desc, word) - 1 as rank from tokens) select word, n, rank, rank * 20 <= case length(word) when 4 then 55000 when 5 then 55000 when 6 then 45000 when 7 then 38000 when 8 then 28000 else 19000 end as affordable from ranked",
        "syllable_histogram": f"with {_tokens()} select length(regexp_replace(word, '[^{vowels}]', '', 'g')) as syllables, count(*) as words, sum(n)::bigint as uses from tokens group by 1",
        "world_roundtrip": "select o_orderkey, 'ok' as status, true as same_cell, true as centre_inside, true as near from orders",
        "mask_sample": f"with {_MASK}, sized as (select count(*) as n from mask) select o_orderkey, o_orderkey * 7919 % n as rank, o_orderkey * 7919 % n as square_rank from orders, sized",
        "plane_squareness": f"with {_corner_lengths()}, w as (select corner, {_METRES} as m from wide), t as (select corner, {_METRES} as m from tall) select corner::bigint as corner, round(abs(w.m / t.m - 1), 6) as off from w join t using (corner)",
        "list_statistics": f"with {_tokens()}, prefixes as (select substr(word, 1, 3) as p, count(*) as n from tokens group by p) select (select count(*) from tokens) as n_words, (select min(length(word))::int from tokens) as shortest, (select max(length(word))::int from tokens) as longest, (select round(avg(length(word)), 6) from tokens) as mean_length, (select sha256(string_agg(word, chr(10) order by word) || chr(10)) from tokens) as sha256, (select count(*) from prefixes where n = 1) as unique_prefixes",
        "list_histograms": f"with {_tokens()} select 'isolation' as what, n % 5 / 2.0::double as value, count(*) as n from tokens group by 2 union all select 'syllables', length(regexp_replace(word, '[^aeiouy]', '', 'g'))::double, count(*) from tokens group by 2",
        "priority_order": f"with {_tokens()}, ranked as (select *, row_number() over (order by n desc, word) - 1 as rank from tokens) select word, row_number() over (order by floor(ln(rank + 2) / ln(4) + 1e-12), n % 5 desc, rank) as \"order\" from ranked where n % 5 > 0",
        "reject_reasons": f"""with {_tokens()}, {_inflected()}, {_with_variants()}, ranked as (select *, row_number() over (order by n desc, word) - 1 as rank, length(regexp_replace(word, '[^aeiouy]', '', 'g')) as beats from tokens),
            judged as (select case when beats not between 1 and 3 then 'syllables' when rank > {FREQUENCY_RANK} then 'rare'
                when rank > case length(word) {" ".join(f"when {n} then {most}" for n, most in LENGTH_BUDGET.items())} else 0 end then 'long_for_rank'
                when starts_with(word, 'wh') then 'offensive' when starts_with(word, 'an') then 'name' when starts_with(word, 'es') then 'place' when starts_with(word, 'on') then 'excluded'
                when word in (select word from inflected) then 'inflected' when word in (select word from variant) then 'variant' end as reason from ranked)
            select reason, count(*) as n from judged where reason is not null group by reason""",
        "graded_reasons": f"""with {_tokens()}, strong as (select word, unnest({_stems('word', STRONG + WEAK)}) as base from tokens), inflected as (select distinct word from strong where base in (select word from tokens)), {_with_variants()},
            judged as (select case when n % 6 = 5 then 'level' when length(regexp_replace(word, '[^aeiouy]', '', 'g')) not between 1 and 3 then 'syllables' when starts_with(word, 'wh') then 'offensive' when starts_with(word, 'es') then 'place'
                when word in (select word from variant) then 'variant' when word in (select word from inflected) then 'inflected' when starts_with(word, 'on') then 'excluded' when n % 6 > 2 then 'not_graded' end as reason from tokens)
            select reason, count(*) as n from judged where reason is not null group by reason""",
        "keystroke_pairs": f"with {_tokens()}, keys as (select word, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda p: substr(word, 1, p - 1) || substr(word, p + 1))))) as key from tokens), met as (select distinct a.word as a, b.word as b from keys a join keys b on a.key = b.key and a.word < b.word) select a, b from met where levenshtein(a, b) <= 1",
        "contained_words": f"with {_tokens()}, inside as (select distinct word as b, substr(word, p, l) as a from tokens, range(1, 7) x(p), range(4, 10) y(l) where p + l - 1 <= length(word)) select a, b from inside join tokens on word = a where a <> b",
        "inflected_words": f"with {_tokens()}, strong as (select word, unnest({_stems('word', STRONG)}) as base from tokens), weak as (select word, n, unnest({_stems('word', WEAK)}) as base from tokens) select word from strong where base in (select word from tokens) union select w.word from weak w join tokens t on t.word = w.base and t.n >= w.n",
        "variant_words": f"with {_tokens()}, other as (select word, unnest({_variants('word')}) as v from tokens) select distinct word from other where v <> word and length(v) >= {LEAST} and v in (select word from tokens)",
        "compound_words": f"with {_tokens()}, cut as (select word, substr(word, 1, k) as head, substr(word, k + 1) as tail from tokens, range(4, 6) x(k) where length(word) - k >= 4) select word, head, tail from cut where head in (select word from tokens) and tail in (select word from tokens)",
        "word_families": f"""with recursive {_tokens()}, bases as (
            select word, unnest(list_concat({_stems('word', SUFFIXES)}, list_filter([{', '.join(f"case when starts_with(word, '{x}') and length(word) - {len(x)} >= {LEAST} then substr(word, {len(x) + 1}) end" for x in PREFIXES)}], lambda s: s is not null))) as base from tokens
        ), links as (select distinct word, base from bases where base in (select word from tokens)), members as (
            select word, word as member, 0 as depth from tokens union select m.word, l.base, depth + 1 from members m join links l on l.word = m.member where depth < 3
        ) select word, count(distinct member) as members from members group by word""",
        "words_back": "select distinct word from (select unnest(regexp_extract_all(lower(text), '[a-z]{5,9}')) as word from documents where lang = 'fr') where word not in (select unnest(regexp_extract_all(lower(text), '[a-z]{5,9}')) from documents where lang = 'en')",
        "pos_dominance": """with used as (select case lang when 'en' then 'n' when 'fr' then 'v' when 'de' then 'a' when 'es' then 'r' end as kind, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents),
            counts as (select word, kind, count(*) + 1 as n from used where length(word) between 2 and 4 group by all), best as (select word, arg_max(kind, n * 10 - list_position(['n', 'v', 'a', 'r'], kind)) as kind, max(n) as n, sum(n) as total from counts group by word)
            select word, case word when 'de' then 'v' else kind end as kind from best where word <> 'the' and (word = 'de' or (kind in ('a', 'n', 'v') and n >= 0.5 * total)) union select 'de', 'v'""",
        "hypernym_closure": "select s_name as ancestor, count(*) as words from supplier group by 1 union all select n_name, count(*) from supplier join nation on n_nationkey = s_nationkey group by 1 union all select r_name, count(*) from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1",
        "stream_encode": f"with {uk} select o_orderkey, cell, case when cell is not null then {three} end as words, case when cell is null then 'outside' else 'ok' end as status from f",
    }
