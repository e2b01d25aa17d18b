"""DuckDB SQL of corpus operators: the same results by other means."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _climb(prefix: str, base: str, path: str, levels: int) -> str:
    """Levels of the trees of `base` (tree, idx, n, digest), and the way of each row of `path`
    (key, tree, idx, n, folded, proof) up to the top of its tree."""
    parts = [f"{prefix}_0 AS (SELECT * FROM {base})", f"{prefix}_path_0 AS (SELECT * FROM {path})"]
    for k in range(levels):
        parts.append(
            f"""{prefix}_run_{k} AS (
                SELECT tree, idx // 16 AS run, n, string_agg(digest, '' ORDER BY idx) AS row_
                FROM {prefix}_{k} WHERE n > 1 GROUP BY tree, idx // 16, n)"""
        )
        parts.append(
            f"""{prefix}_{k + 1} AS (
                SELECT tree, run AS idx, (n + 15) // 16 AS n, sha256(row_) AS digest FROM {prefix}_run_{k})"""
        )
        left, right = "substr(row_, 1, 64 * (p.idx % 16))", "substr(row_, 64 * (p.idx % 16) + 65)"
        parts.append(
            f"""{prefix}_path_{k + 1} AS (
                SELECT key, p.tree, p.idx // 16 AS idx, (p.n + 15) // 16 AS n,
                       CASE WHEN p.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded,
                       CASE WHEN p.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof
                FROM {prefix}_path_{k} p LEFT JOIN {prefix}_run_{k} r
                  ON p.n > 1 AND p.tree = r.tree AND p.idx // 16 = r.run)"""
        )
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM {prefix}_{k} WHERE n = 1" for k in range(levels + 1))
    parts.append(f"{prefix}_tops AS ({tops})")
    return ",".join(parts)


# trees of up to 16^7 documents a source, and 16^5 sources
MERKLE = f"""WITH marked AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
                THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
           END AS tampered
    FROM documents),
placed AS (
    SELECT *, row_number() OVER () AS key,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS n,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM marked),
leaves AS (SELECT tree, idx, n, leaf AS digest FROM placed),
ways AS (SELECT key, tree, idx, n, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed),
{_climb("of_source", "leaves", "ways", 7)},
subroots AS (SELECT -1 AS tree, tree AS idx, count(*) OVER () AS n, digest FROM of_source_tops),
onward AS (
    SELECT key, -1 AS tree, tree AS idx, (SELECT count(*) FROM of_source_tops) AS n, folded, proof
    FROM of_source_path_7),
{_climb("above", "subroots", "onward", 5)}
SELECT p.doc_id, p.source, p.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
       w.folded AS folded_root, w.folded = r.digest AS verified
FROM placed p JOIN above_path_5 w USING (key) JOIN of_source_tops s ON p.tree = s.tree, above_tops r"""


def _conversations() -> str:
    """Costs and texts that remain, from the last row of a conversation back to the first: for
    each state of the grammar the cheapest (cost, audit), and the lines that it leaves."""
    states = ("0", "s", "u", "a")
    made = {"0": "u", "s": "u", "u": "a", "a": "u"}
    role = {"0": "user", "s": "user", "u": "assistant", "a": "user"}
    kept = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def with_insertions(own: dict[str, str], name: str) -> str:
        """`own` has a state's cheapest struct {c, e, t} without insertions before."""

        def inserted(state: str, times: int) -> str:
            for_lines, at = [], state
            for _ in range(times):
                for_lines.append(f"{role[at]}:")
                at = made[at]
            lines = "".join(f"'{x}' || chr(10) || " for x in for_lines)
            v = own[at]
            return (
                f"{{'c': {v}.c + {5 * times}, 'e': '{'I' * times}' || {v}.e, 't': {lines}{v}.t}}"
                if times
                else v
            )

        return ", ".join(
            f"list_min([{', '.join(inserted(s, k) for k in range(4))}]) AS {name}{s}" for s in states
        )

    never = "{'c': 1000000000, 'e': '', 't': ''}"
    last = {s: "{'c': 0, 'e': '', 't': ''}" if s in "0a" else never for s in states}
    # structs compare by cost, then audit; what they leave is one and the same for both
    step = {}
    for s in states:
        ways = [f"{{'c': v{s}.c + 2, 'e': 'D' || v{s}.e, 't': v{s}.t}}"]
        line = "|| ':' || words || chr(10) ||"
        for initial, to in kept[s].items():
            ways.append(
                f"CASE WHEN good AND initial = '{initial}' THEN {{'c': v{to}.c + extra, 'e': 'K' || v{to}.e, "
                f"'t': role {line} v{to}.t}} ELSE {never} END"
            )
        to = made[s]
        ways.append(
            f"CASE WHEN good THEN {{'c': v{to}.c + 1 + extra, 'e': 'R' || v{to}.e, "
            f"'t': '{role[s]}' {line} v{to}.t}} ELSE {never} END"
        )
        step[s] = f"list_min([{', '.join(ways)}])"
    columns = ", ".join(f"v{s}" for s in states)
    own = ", ".join(f"{step[s]} AS w{s}" for s in states)
    code = crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return f"""WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS words, {code} % 20 AS code
    FROM conversations),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
               CASE code WHEN 1 THEN '' WHEN 2 THEN translate(words, '.!?', '') ELSE words END AS words,
               unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM coded WHERE code <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || words), role)
                  AS place FROM hurt),
    judged AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, words ORDER BY place) > 1 AS again,
               regexp_extract(words, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final_
        FROM placed),
    symbols AS (
        SELECT *, left(role, 1) AS initial,
               CASE WHEN final_ = '' THEN 'blank' WHEN again THEN 'duplicate'
                    WHEN final_ NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS following
        FROM judged),
    told AS (
        SELECT conv_id, count(*) AS n_rows,
               coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (WHERE fault = 'blank') AS blank,
               count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
               count(*) FILTER (WHERE fault = 'truncated') AS truncated,
               count(*) FILTER (WHERE following IS NOT NULL
                                AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
        FROM symbols GROUP BY conv_id),
    costs(conv_id, place, {columns}) AS (
        SELECT conv_id, n_rows + 1, {with_insertions(last, "v")} FROM told
        UNION ALL
        SELECT conv_id, place, {with_insertions({s: f"w{s}" for s in states}, "v")}
        FROM (SELECT conv_id, place, {own}
              FROM (SELECT c.*, y.role, y.words, y.initial, y.fault IN ('', 'truncated') AS good,
                           CASE WHEN y.fault = 'truncated' THEN 5 ELSE 0 END AS extra
                    FROM (SELECT conv_id, place - 1 AS place, {columns} FROM costs) c
                    JOIN symbols y ON c.conv_id IS NOT DISTINCT FROM y.conv_id AND c.place = y.place)))
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.e, '') AS audit,
       sha256(coalesce(left(v0.t, greatest(length(v0.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN told t ON i.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN (SELECT * FROM costs WHERE place = 1) c ON i.conv_id IS NOT DISTINCT FROM c.conv_id"""


CONVERSATIONS = _conversations()
