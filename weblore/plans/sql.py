"""SQL fragments shared by the SQL counterparts of the queries."""

from __future__ import annotations

PAIRS = "pairs as (select distinct on (pair_id) * from candidate_pairs)"
PAGES = "pages as (select distinct on (page_id) * from webpage)"
NODES = "nodes as (select distinct node_id, node_text from kb_node)"
EDGES = "edges as (select distinct source_id, dest_id, edge_type_id, edge_type_text from kb_edge)"


def clean(c: str) -> str:
    """SQL of the text cleaning."""
    flat = f"translate(lower({c}), '-' || chr(10) || chr(9) || chr(13), '    ')"
    bare = f"regexp_replace(regexp_replace({flat}, '[\"\\\\/'',;.|:$]', '', 'g'), '[^\\x20-\\x7e]', '', 'g')"
    return f"regexp_replace(regexp_replace(trim({bare}, ' '), ' +', ' ', 'g'), '&nbs.*$', '')"


def key(c: str) -> str:
    """SQL of the lower-case words of a text."""
    return f"trim(regexp_replace(lower({c}), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ')"


def hash_id(c: str) -> str:
    """SQL of the hashed id."""
    return f"list_reduce(list_transform(string_split(sha1({c}), ''), lambda d: (instr('0123456789abcdef', d) - 1)::hugeint), lambda a, b: (a * 16 + b) % 10000000000000000)::bigint"


def bare(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\(.*\\)', '', 's'), ' ')"


def alike(a: str, b: str) -> str:
    """SQL of fuzzy equality."""
    both = f"({bare(a)} <> '' and {bare(b)} <> '')"
    x, y = f"(case when {both} then {bare(a)} else {a} end)", f"(case when {both} then {bare(b)} else {b} end)"
    least = f"(case when length({a}) < 10 and length({b}) < 10 then 0.85::double else 0.80::double end)"
    return (f"(case when {x} = '' or {y} = '' then false else "
            f"(length({x}) + length({y}) - levenshtein({x}, {y}))::double / (length({x}) + length({y})) >= {least} end)")


def prefixes(c: str) -> str:
    """SQL list of a path's prefixes."""
    steps = f"list_filter(string_split({c}, '/'), lambda s: s <> '')"
    return f"list_transform(range(1, len({steps}) + 1), lambda n: '/' || array_to_string(({steps})[1:n], '/'))"


def dom_distance(a: str, b: str) -> str:
    return f"(len(list_filter({prefixes(a)}, lambda p: not list_contains({prefixes(b)}, p))) + len(list_filter({prefixes(b)}, lambda q: not list_contains({prefixes(a)}, q))))::int"
