"""Oracle SQL (DuckDB) for every registered query: the same results, written independently in SQL
over the same parquet views. Fakes reuse the SQL twins of the generators so values match."""

from __future__ import annotations

from ..config import DEFAULT_SEED, LABEL2ID
from ..functions.fakes import SQL_FAKERS
from ..functions.patterns import RE2_PATTERNS
from ..functions.hashing import sql_hash32, sql_hash_key, sql_str
from ..sources.tables import CONTACT_CORPUS_SQL, DOCUMENTS_SQL, PAGE_TEXTS_SQL

SEED = DEFAULT_SEED


def find_sql(kind: str, source_sql: str, out: str) -> str:
    p = sql_str(RE2_PATTERNS[kind])
    return (f"SELECT doc_id, unnest(range(0, len(m))) AS ord, unnest(m) AS {out} "
            f"FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m FROM ({source_sql}) s) t")


def rewrite_expr(kind: str, g_sql: str, m_sql: str, text_sql: str, scope_sql: str | None,
                 seed: int = SEED) -> str:
    """SQL twin of ``redact_pattern`` over precomputed gaps ``g`` (string_split_regex) and
    matches ``m`` (regexp_extract_all): matches replaced by their fake."""
    fake = SQL_FAKERS[kind](f"{m_sql}[i]", scope_sql, seed)
    return (f"(CASE WHEN len({m_sql}) = 0 THEN {text_sql} ELSE "
            f"array_to_string(list_transform({g_sql}, lambda g, i: g || CASE WHEN i <= len({m_sql}) THEN {fake} ELSE '' END), '') END)")


def redact_sql(kinds: tuple, source_sql: str, extra_cols: str = "") -> str:
    """Chained CTEs, two per kind (find, then rewrite), each reading the previous output."""
    ctes = [f"s0 AS (SELECT doc_id{extra_cols}, text AS t FROM ({source_sql}) src)"]
    for i, kind in enumerate(kinds, start=1):
        p = sql_str(RE2_PATTERNS[kind])
        ctes.append(f"f{i} AS (SELECT doc_id{extra_cols}, t, string_split_regex(t, {p}) AS g, "
                    f"regexp_extract_all(t, {p}) AS m FROM s{i - 1})")
        ctes.append(f"s{i} AS (SELECT doc_id{extra_cols}, {rewrite_expr(kind, 'g', 'm', 't', 'doc_id')} AS t "
                    f"FROM f{i})")
    return f"WITH {', '.join(ctes)} SELECT doc_id{extra_cols}, t AS redacted_text FROM s{len(kinds)}"


def contact_sql() -> dict[str, str]:
    return {
        "find_emails": find_sql("email", DOCUMENTS_SQL, "email"),
        "find_phones": find_sql("phone", DOCUMENTS_SQL, "phone"),
        "find_urls": find_sql("url", PAGE_TEXTS_SQL, "url"),
        "redact_emails": redact_sql(("email",), DOCUMENTS_SQL),
        "redact_phones": redact_sql(("phone",), DOCUMENTS_SQL),
        "redact_urls": redact_sql(("url",), PAGE_TEXTS_SQL),
        "redact_contacts": redact_sql(("email", "phone", "url"), CONTACT_CORPUS_SQL, ", source"),
    }


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(contact_sql())
    out.update(token_sql())
    out.update(casenote_sql())
    out.update(io_sql())
    return out


# ------------------------------------------------------------------ tokens, windows, samples

from ..functions.arrays import TOKEN_PATTERN_RE2  # noqa: E402

_TP = sql_str(TOKEN_PATTERN_RE2)


def tokens_cte(source_sql: str = DOCUMENTS_SQL, name: str = "tok") -> str:
    """Exploded tokens with offsets: running sum of gap + token lengths (window function)."""
    return (f"{name}_a AS (SELECT doc_id, regexp_extract_all(text, {_TP}) AS toks, "
            f"string_split_regex(text, {_TP}) AS gaps FROM ({source_sql}) s), "
            f"{name}_b AS (SELECT doc_id, unnest(range(0, len(toks))) AS pos, unnest(toks) AS token, "
            f"unnest(gaps[1:len(toks)]) AS gap FROM {name}_a), "
            f"{name} AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, "
            f"CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(token) AS INTEGER) AS start, "
            f"CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS \"end\" FROM {name}_b)")


WINDOW_CFG_SQL = "(VALUES (510, 0, 512), (100, 20, 64)) c(win_size, win_overlap, max_len)"


def windows_cte() -> str:
    """Token rows assigned to windows (a token sits in every window whose range holds it)."""
    return (f"{tokens_cte()}, "
            f"ntok AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), "
            f"wins AS (SELECT doc_id, win_size, win_overlap, max_len, unnest(range(0, CAST(greatest(ceil((n - win_overlap) "
            f"/ (win_size - win_overlap)), 1) AS BIGINT))) AS window_no FROM ntok, {WINDOW_CFG_SQL}), "
            f"wtok AS (SELECT w.win_size, w.win_overlap, w.max_len, w.doc_id, CAST(w.window_no AS INTEGER) AS window_no, "
            f"t.pos, t.token, t.start, t.\"end\" FROM wins w JOIN tok t ON t.doc_id = w.doc_id "
            f"AND t.pos >= w.window_no * (w.win_size - w.win_overlap) "
            f"AND t.pos < w.window_no * (w.win_size - w.win_overlap) + w.win_size)")


def padded_cte() -> str:
    return (f"{windows_cte()}, "
            f"wl AS (SELECT win_size, max_len, doc_id, window_no, list(token ORDER BY pos) AS l FROM wtok "
            f"GROUP BY ALL), "
            f"padded AS (SELECT win_size, max_len, doc_id, window_no, CASE WHEN len(l) >= max_len THEN l[1:max_len] "
            f"ELSE list_concat(l, list_transform(range(max_len - len(l)), lambda x: '[PAD]')) END AS p FROM wl)")


def vocab_cte() -> str:
    return ("vcount AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token), "
            "vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 1 AS INTEGER) AS id, "
            "cnt AS count FROM vcount)")


def token_sql() -> dict[str, str]:
    return {
        "tokenize_offsets": f"WITH {tokens_cte()} SELECT doc_id, pos, token, start, \"end\" FROM tok",
        "special_tokens": (
            f"SELECT doc_id, CAST(len(toks) + 2 AS INTEGER) AS n_with_special, '<s>' AS first_token, "
            f"coalesce(toks[1], '</s>') AS second_token, '</s>' AS last_token, true AS roundtrip "
            f"FROM (SELECT doc_id, regexp_extract_all(text, {_TP}) AS toks FROM documents) d"),
        "token_windows": (
            f"WITH {windows_cte()} SELECT win_size, win_overlap, doc_id, window_no, CAST(count(*) AS INTEGER) AS n_tokens, "
            f"arg_min(token, pos) AS first_token, arg_max(token, pos) AS last_token, "
            f"CAST(min(start) AS INTEGER) AS span_start, CAST(max(\"end\") AS INTEGER) AS span_end "
            f"FROM wtok GROUP BY win_size, win_overlap, doc_id, window_no"),
        "pad_truncate_mask": (
            f"WITH {padded_cte()} SELECT win_size, doc_id, window_no, CAST(len(p) AS INTEGER) AS padded_len, "
            f"CAST(len(list_filter(p, lambda x: x <> '[PAD]')) AS INTEGER) AS mask_sum, "
            f"array_to_string(p, ' ') AS tokens_text, "
            f"array_to_string(list_transform(p, lambda x: CASE WHEN x = '[PAD]' THEN '0' ELSE '1' END), '') AS mask_text "
            f"FROM padded"),
        "vocabulary": f"WITH {tokens_cte()}, {vocab_cte()} SELECT token, id, count FROM vocab",
        "vocab_encode": (
            f"WITH {padded_cte()}, {vocab_cte()}, "
            f"pe AS (SELECT doc_id, window_no, unnest(range(0, len(p))) AS i, unnest(p) AS token FROM padded "
            f"WHERE win_size = 510), "
            f"pi AS (SELECT pe.doc_id, pe.window_no, pe.i, CASE WHEN pe.token = '[PAD]' THEN 0 "
            f"ELSE coalesce(v.id, 1) END AS id FROM pe LEFT JOIN vocab v ON v.token = pe.token) "
            f"SELECT doc_id, window_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS ids_text "
            f"FROM pi GROUP BY doc_id, window_no"),
        "logit_argmax": (
            "SELECT vec_id, CAST(slot - 1 AS INTEGER) AS slot, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS label_id, "
            "(['O','B-DATE','I-DATE','B-EMAIL','I-EMAIL','B-LOCATION','I-LOCATION','B-PERSON','I-PERSON',"
            "'B-PHONE_NUMBER','I-PHONE_NUMBER'])[list_position(l, list_max(l))] AS label "
            "FROM (SELECT vec_id, slot, embedding[(slot - 1) * 11 + 1:slot * 11] AS l FROM "
            "(SELECT vec_id, embedding, unnest(range(1, CAST(ceil(len(embedding) / 11) AS BIGINT) + 1)) AS slot FROM embeddings) u) e "
            "WHERE len(l) = 11"),
        "merge_windows": (
            f"WITH {tokens_cte()}, per AS (SELECT doc_id, count(*) AS n, arg_min(token, pos) AS first_token, "
            f"arg_max(token, pos) AS last_token FROM tok GROUP BY doc_id) "
            f"SELECT doc_id, CAST(ceil(n / 510) AS INTEGER) AS n_windows, CAST(n AS INTEGER) AS n_tokens, first_token, "
            f"last_token, CAST(n - 2 * (n // 510) - CASE WHEN n % 510 = 0 THEN 0 WHEN n % 510 = 1 THEN 1 ELSE 2 END "
            f"AS INTEGER) AS n_tokens_trimmed, true AS same_as_source FROM per"),
        "attach_documents": (
            f"WITH {tokens_cte()}, per AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) "
            f"SELECT 'inner' AS how, d.doc_id, CAST(length(d.text) AS INTEGER) AS n_chars, CAST(p.n AS INTEGER) AS n_tokens "
            f"FROM documents d JOIN per p ON p.doc_id = d.doc_id UNION ALL "
            f"SELECT 'left' AS how, d.doc_id, CAST(length(d.text) AS INTEGER) AS n_chars, CAST(p.n AS INTEGER) AS n_tokens "
            f"FROM documents d LEFT JOIN per p ON p.doc_id = d.doc_id"),
    }


# ------------------------------------------------------------------ case notes

from ..functions.dates import sql_fake_date  # noqa: E402
from ..functions.fakes import sql_distinct_name, sql_fake_location  # noqa: E402
from ..operators.classify import HONORIFICS, MONTHS  # noqa: E402
from .casenotes import CASE_NOTES_SQL, DATED_NOTES_SQL, GAZETTEER_SQL  # noqa: E402

_H = "(" + ", ".join(sql_str(h) for h in HONORIFICS) + ")"
_M = "(" + ", ".join(sql_str(m) for m in MONTHS) + ")"


def _cap(x):
    return f"coalesce(regexp_matches({x}, '^\\p{{Lu}}(\\p{{L}}*\\p{{Ll}}\\p{{L}}*)?$'), false)"


def _rx(x, p):
    return f"coalesce(regexp_matches({x}, '{p}'), false)"


def _spaced(g):
    return f"coalesce(length({g}) > 0 AND NOT contains({g}, chr(10)), false)"


def _tight(g):
    return f"coalesce({g} = '', false)"


def notes_tagged_cte() -> str:
    """Case notes, tokens, rule labels (PERSON > DATE > LOCATION) as rows, via lag / lead."""
    lead = ", ".join([f"lead(token, {k}) OVER w AS tp{k}" for k in range(1, 5)]
                     + [f"lead(gap, {k}) OVER w AS gp{k}" for k in range(1, 5)])
    d12 = lambda x: _rx(x, r"^\d{1,2}$")
    d4 = lambda x: _rx(x, r"^\d{4}$")
    yy = lambda x: _rx(x, r"^(\d{2}|\d{4})$")
    mon = lambda x: f"coalesce({x} IN {_M}, false)"
    tight4 = " AND ".join(_tight(f"gp{k}") for k in range(1, 5))
    cue = (f"(coalesce(tm1 = ':' AND lower(tm2) = 'name', false) OR coalesce(tm1 = '.' AND tm2 IN {_H}, false) "
           f"OR coalesce(tm1 IN {_H}, false))")
    plen = (f"CASE WHEN {cue} AND {_cap('token')} AND NOT contains(gap, chr(10)) THEN 1 + "
            f"CASE WHEN {_cap('tp1')} AND {_spaced('gp1')} THEN 1 + "
            f"CASE WHEN {_cap('tp2')} AND {_spaced('gp2')} THEN 1 + "
            f"CASE WHEN {_cap('tp3')} AND {_spaced('gp3')} THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END ELSE 0 END")
    slash = f"{d12('token')} AND coalesce(tp1 = '/', false) AND {d12('tp2')} AND coalesce(tp3 = '/', false) AND {yy('tp4')} AND {tight4}"
    iso = f"{d4('token')} AND coalesce(tp1 = '-', false) AND {d12('tp2')} AND coalesce(tp3 = '-', false) AND {d12('tp4')} AND {tight4}"
    mdyc = (f"{mon('token')} AND {d12('tp1')} AND coalesce(tp2 = ',', false) AND {d4('tp3')} AND {_spaced('gp1')} "
            f"AND {_tight('gp2')} AND {_spaced('gp3')}")
    mdy = f"{mon('token')} AND {d12('tp1')} AND {d4('tp2')} AND {_spaced('gp1')} AND {_spaced('gp2')}"
    dmy = f"{d12('token')} AND {mon('tp1')} AND {d4('tp2')} AND {_spaced('gp1')} AND {_spaced('gp2')}"
    dlen = f"CASE WHEN ({slash}) OR ({iso}) THEN 5 WHEN {mdyc} THEN 4 WHEN ({mdy}) OR ({dmy}) THEN 3 ELSE 0 END"

    def bio(col, maxlen, ent):
        cov = " OR ".join(f"coalesce(lag({col}, {k}) OVER w > {k}, false)" for k in range(1, maxlen))
        return f"CASE WHEN {cov} THEN 'I-{ent}' WHEN {col} > 0 THEN 'B-{ent}' ELSE 'O' END"
    return (f"notes AS ({CASE_NOTES_SQL}), gaz AS ({GAZETTEER_SQL}), {tokens_cte('SELECT doc_id, text FROM notes', 'nt')}, "
            f"ntg AS (SELECT nt.*, b.gap FROM nt JOIN nt_b b ON b.doc_id = nt.doc_id AND CAST(b.pos AS INTEGER) = nt.pos), "
            f"r1 AS (SELECT *, lag(token, 1) OVER w AS tm1, lag(token, 2) OVER w AS tm2, {lead} FROM ntg "
            f"WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
            f"r2 AS (SELECT doc_id, pos, token, start, \"end\", gap, {plen} AS plen, {dlen} AS dlen FROM r1), "
            f"r3 AS (SELECT doc_id, pos, token, start, \"end\", gap, {bio('plen', 4, 'PERSON')} AS lp, "
            f"{bio('dlen', 5, 'DATE')} AS ld FROM r2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
            f"r4 AS (SELECT doc_id, pos, token, start, \"end\", gap, CASE WHEN lp <> 'O' THEN lp ELSE ld END AS lm FROM r3), "
            f"tagged AS (SELECT doc_id, pos, token, start, \"end\", gap, CASE WHEN lm <> 'O' THEN lm "
            f"WHEN {_rx('token', '^\\p{Lu}')} AND lower(token) IN (SELECT entry FROM gaz) THEN 'B-LOCATION' "
            f"ELSE 'O' END AS label FROM r4)")


def mentions_cte() -> str:
    return (f"{notes_tagged_cte()}, "
            f"e1 AS (SELECT *, CASE WHEN label = 'O' THEN 'O' ELSE substr(label, 3) END AS et, "
            f"lag(CASE WHEN label = 'O' THEN 'O' ELSE substr(label, 3) END) OVER (PARTITION BY doc_id ORDER BY pos) AS pet "
            f"FROM tagged), "
            f"e2 AS (SELECT *, sum(CASE WHEN pos > 0 AND label LIKE 'I-%' AND pet = et THEN 0 ELSE 1 END) "
            f"OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e1), "
            f"e3 AS (SELECT doc_id, run, arg_min(label, pos) AS head, min(pos) AS first_pos, "
            f"string_agg(CASE WHEN pos > fp AND gap <> '' THEN ' ' ELSE '' END || token, '' ORDER BY pos) AS value, "
            f"CAST(min(start) AS INTEGER) AS start, CAST(max(\"end\") AS INTEGER) AS \"end\" "
            f"FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, run) AS fp FROM e2) GROUP BY doc_id, run), "
            f"ments AS (SELECT doc_id, substr(head, 3) AS entity, CAST(row_number() OVER (PARTITION BY doc_id, "
            f"substr(head, 3) ORDER BY first_pos) - 1 AS INTEGER) AS ord, value, start, \"end\" FROM e3 "
            f"WHERE head LIKE 'B-%' AND substr(head, 3) IN ('PERSON', 'LOCATION', 'DATE'))")


_PARSE = ("CAST(coalesce(try_strptime({v}, '%m/%d/%Y'), try_strptime({v}, '%Y-%m-%d'), "
          "try_strptime({v}, '%B %-d, %Y')) AS DATE)")


def maps_cte() -> str:
    name_parts = (
        "np AS (SELECT doc_id, ord, value, unnest(range(0, len(p))) AS i, unnest(p) AS part, len(p) AS n FROM "
        "(SELECT doc_id, ord, value, list_filter(string_split_regex(trim(value), '\\s+'), lambda x: x <> '') AS p "
        "FROM ments WHERE entity = 'PERSON')), "
        "na AS (SELECT doc_id, lower(part) AS key, value, ord, "
        "CASE WHEN n = 1 THEN 'last' WHEN i = 0 THEN 'first' WHEN i = n - 1 THEN 'last' ELSE 'middle' END AS role, "
        "CASE WHEN n = 1 THEN 1 WHEN i = n - 1 THEN 1 WHEN i = 0 THEN 0 ELSE i + 1 END AS step FROM np), "
        "nw AS (SELECT doc_id, key, arg_max(value, ord * 1000 + step) AS value, arg_max(role, ord * 1000 + step) AS role "
        "FROM na GROUP BY doc_id, key)")
    return (f"{mentions_cte()}, {name_parts}, "
            f"nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role = 'last' ORDER BY key) - 1 AS rank FROM nw), "
            f"name_map AS (SELECT doc_id, key AS real, CASE WHEN role = 'last' THEN {sql_distinct_name('last', 'rank', 'doc_id', SEED, 'key')} "
            f"ELSE {sql_distinct_name('first', 'rank', 'doc_id', SEED, 'key')} END AS fake FROM nr), "
            f"locs AS (SELECT doc_id, value, min(ord) AS first_ord FROM ments WHERE entity = 'LOCATION' GROUP BY doc_id, value), "
            f"location_map AS (SELECT doc_id, value AS real, {sql_fake_location('value', 'doc_id', SEED)} AS fake, first_ord "
            f"FROM locs), "
            f"dts AS (SELECT DISTINCT doc_id, value FROM ments WHERE entity = 'DATE'), "
            f"date_map AS (SELECT doc_id, value AS real, {sql_fake_date('value', 'doc_id', SEED, _PARSE.format(v='value'))} "
            f"AS fake FROM dts)")


def _entries(table: str, order: str) -> str:
    return (f"(SELECT doc_id, list({{'real': real, 'fake': fake}} ORDER BY {order}) AS ent FROM {table} "
            f"GROUP BY doc_id)")


def _alt(ent: str, flags: str = "") -> str:
    return (f"'{flags}' || array_to_string(list_transform({ent}, lambda e: '\\Q' || e.real || '\\E'), '|')")


def _lookup(ent: str, key: str) -> str:
    return f"(list_filter({ent}, lambda e: e.real = {key}))[1].fake"


def rewrite_ctes() -> str:
    """PERSON guarded -> LOCATION -> DATE, as rows of (doc_id, t1, t2, t3)."""
    by_len = "length(real) DESC, real"
    spans = ("ps AS (SELECT doc_id, list({'s': start, 'e': \"end\"}) AS sp FROM tagged "
             "WHERE label IN ('B-PERSON', 'I-PERSON') GROUP BY doc_id)")
    w1 = (f"w1 AS (SELECT n.doc_id, n.text, nm.ent AS nent, ps.sp, lm.ent AS lent, dm.ent AS dent FROM notes n "
          f"LEFT JOIN {_entries('name_map', by_len)} nm ON nm.doc_id = n.doc_id "
          f"LEFT JOIN ps ON ps.doc_id = n.doc_id "
          f"LEFT JOIN {_entries('location_map', by_len)} lm ON lm.doc_id = n.doc_id "
          f"LEFT JOIN {_entries('date_map', by_len)} dm ON dm.doc_id = n.doc_id)")
    g1 = (f"g1 AS (SELECT doc_id, text, string_split_regex(text, {_alt('nent', '(?i)')}) AS g, "
          f"regexp_extract_all(text, {_alt('nent', '(?i)')}) AS m, nent FROM w1 WHERE len(nent) > 0)")
    u1 = ("u1 AS (SELECT doc_id, i, gp, m[i] AS mt, "
          "sum(length(gp) + coalesce(length(m[i]), 0)) OVER (PARTITION BY doc_id ORDER BY i "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - coalesce(length(m[i]), 0) AS st, nent FROM "
          "(SELECT doc_id, m, nent, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS gp FROM g1))")
    v1 = (f"v1 AS (SELECT doc_id, string_agg(gp || CASE WHEN mt IS NULL THEN '' "
          f"WHEN EXISTS (SELECT 1 FROM tagged t WHERE t.doc_id = u1.doc_id AND t.label IN ('B-PERSON', 'I-PERSON') "
          f"AND t.start <= u1.st AND u1.st < t.\"end\") THEN coalesce({_lookup('nent', 'lower(mt)')}, mt) ELSE mt END, "
          f"'' ORDER BY i) AS t1 FROM u1 GROUP BY doc_id)")
    r1 = "r1w AS (SELECT w1.*, coalesce(v1.t1, w1.text) AS t1 FROM w1 LEFT JOIN v1 ON v1.doc_id = w1.doc_id)"

    def single_pass(src, col, ent, flags, norm):
        pat = _alt(ent, flags)
        return (f"(CASE WHEN coalesce(len({ent}), 0) = 0 THEN {col} ELSE array_to_string(list_transform("
                f"string_split_regex({col}, {pat}), lambda x, i: x || CASE WHEN i > len(regexp_extract_all({col}, {pat})) "
                f"THEN '' ELSE coalesce((list_filter({ent}, lambda e: {norm('e.real')} = "
                f"{norm(f'regexp_extract_all({col}, {pat})[i]')}))[1].fake, regexp_extract_all({col}, {pat})[i]) END), '') END)")
    r2 = f"r2w AS (SELECT *, {single_pass('r1w', 't1', 'lent', '', lambda x: x)} AS t2 FROM r1w)"
    r3 = f"r3w AS (SELECT *, {single_pass('r2w', 't2', 'dent', '(?i)', lambda x: f'lower({x})')} AS t3 FROM r2w)"
    return f"{spans}, {w1}, {g1}, {u1}, {v1}, {r1}, {r2}, {r3}"


def scored_windows_sql() -> str:
    """The linear model's scores of each token as a list, the first of the largest taken."""
    from ..operators.models import linear_weights
    upper, digit = "CAST(token >= 'A' AND token < '[' AS INTEGER)", "CAST(token >= '0' AND token < ':' AS INTEGER)"
    scores = ", ".join(f"{a} * length(token) + {b} * {upper} + {c} * {digit} + {d}" for a, b, c, d in linear_weights())
    return (f"WITH {tokens_cte()}, sc AS (SELECT doc_id, CAST(pos // 510 AS INTEGER) AS window_no, pos, [{scores}] AS l FROM tok) "
            "SELECT doc_id, window_no, CAST(count(*) AS INTEGER) AS n_tokens, string_agg(CAST(list_position(l, list_max(l)) - 1 AS VARCHAR), ' ' ORDER BY pos) "
            "AS label_ids FROM sc GROUP BY doc_id, window_no")


def spans_sql() -> str:
    """Every find as a row on the original text; one that meets a longer (or equal and earlier) one goes; the rest is written by position."""
    found = []
    for rank, kind in ((3, "email"), (4, "phone"), (5, "url")):
        p = sql_str(RE2_PATTERNS[kind])
        found.append(
            f"SELECT doc_id, CAST(sum(length(gap) + length(m)) OVER w - length(m) AS INTEGER) AS start, CAST(sum(length(gap) + length(m)) OVER w AS INTEGER) "
            f"AS \"end\", {rank} AS rank, m AS value, {SQL_FAKERS[kind]('m', 'doc_id', SEED)} AS fake FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, "
            f"unnest(ms) AS m, unnest(gs[1:len(ms)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gs "
            f"FROM notes)) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    persons = (
        "SELECT doc_id, start, \"end\", 0 AS rank, value, string_agg(coalesce(fake, part), ' ' ORDER BY i) AS fake FROM (SELECT p.*, nm.fake FROM "
        "(SELECT doc_id, start, \"end\", value, unnest(range(0, len(ps))) AS i, unnest(ps) AS part FROM (SELECT *, string_split(value, ' ') AS ps FROM ments "
        "WHERE entity = 'PERSON')) p LEFT JOIN name_map nm ON nm.doc_id = p.doc_id AND nm.real = lower(p.part)) GROUP BY ALL")
    others = [f"SELECT m.doc_id, m.start, m.\"end\", {rank} AS rank, m.value, t.fake FROM ments m JOIN {table} t ON t.doc_id = m.doc_id AND t.real = m.value "
              f"WHERE m.entity = '{entity}'" for rank, entity, table in ((1, "DATE", "date_map"), (2, "LOCATION", "location_map"))]
    every = " UNION ALL ".join([f"SELECT doc_id, start, \"end\", rank, value, fake FROM ({persons})", *others, *found])
    return (
        f"WITH {maps_cte()}, fs AS ({every}), keep AS (SELECT * FROM fs f WHERE NOT EXISTS (SELECT 1 FROM fs g WHERE g.doc_id = f.doc_id AND g.start < f.\"end\" "
        f"AND f.start < g.\"end\" AND ((f.start - f.\"end\") > (g.start - g.\"end\") OR ((f.start - f.\"end\") = (g.start - g.\"end\") AND "
        f"(g.start < f.start OR (g.start = f.start AND g.rank < f.rank)))))), "
        f"kp AS (SELECT k.*, n.text, coalesce(lag(k.\"end\") OVER w, 0) AS before FROM keep k JOIN notes n ON n.doc_id = k.doc_id "
        f"WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.start)), "
        f"ag AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || fake, '' ORDER BY start) AS body, max(\"end\") AS last FROM kp GROUP BY doc_id) "
        f"SELECT n.doc_id, coalesce(a.body || substr(n.text, a.last + 1), n.text) AS redacted_text FROM notes n LEFT JOIN ag a ON a.doc_id = n.doc_id")


def casenote_sql() -> dict[str, str]:
    return {
        "rule_tag": f"WITH {notes_tagged_cte()} SELECT doc_id, pos, token, label FROM tagged WHERE label <> 'O'",
        "bio_spans": f"WITH {mentions_cte()} SELECT doc_id, entity, ord, value, start, \"end\" FROM ments",
        "entities_wide": (
            f"WITH {mentions_cte()} SELECT n.doc_id, "
            + ", ".join(f"coalesce((SELECT string_agg(value, '|' ORDER BY ord) FROM ments m WHERE m.doc_id = n.doc_id "
                        f"AND m.entity = '{e}'), '') AS {c}"
                        for e, c in (("PERSON", "names"), ("LOCATION", "locations"), ("DATE", "dates")))
            + " FROM notes n"),
        "name_map": f"WITH {maps_cte()} SELECT doc_id, real, fake FROM name_map",
        "location_map": f"WITH {maps_cte()} SELECT doc_id, real, fake FROM location_map",
        "date_map": (f"WITH {maps_cte()} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "
                     f"length(real) DESC, real) - 1 AS INTEGER) AS rank, real, fake FROM date_map"),
        "replace_literal": (
            f"WITH {maps_cte()} SELECT n.doc_id, CASE WHEN l.ent IS NULL THEN n.text ELSE "
            f"list_reduce(l.ent, lambda acc, e: replace(acc, e.real, e.fake), n.text) END AS text_out "
            f"FROM notes n LEFT JOIN {_entries('location_map', 'first_ord')} l ON l.doc_id = n.doc_id"),
        "replace_guarded": f"WITH {maps_cte()}, {rewrite_ctes()} SELECT doc_id, t1 AS text_out FROM r1w",
        "redact_documents": (
            f"WITH {maps_cte()}, {rewrite_ctes()}, "
            + redact_sql(("email", "phone", "url"), "SELECT doc_id, t3 AS text FROM r3w").removeprefix("WITH ")),
        "redact_spans": spans_sql(),
        "match_in_span": f"WITH {notes_tagged_cte()} SELECT doc_id, pos, token FROM tagged WHERE label IN ('B-PERSON', 'I-PERSON')",
        "scored_windows": scored_windows_sql(),
        "date_layouts": f"SELECT doc_id, 0 AS ord, 29 AS start, value, parsed, {sql_fake_date('value', 'doc_id', SEED, 'parsed')} AS fake FROM ({DATED_NOTES_SQL})",
        "sample_batches": (
            f"WITH {tokens_cte()}, per AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), ws AS (SELECT doc_id, CAST(unnest(range(0, "
            f"CAST(greatest(ceil((n - 20) / 80), 1) AS BIGINT))) AS INTEGER) AS window_no FROM per), ns AS (SELECT doc_id, window_no, row_number() OVER "
            f"(ORDER BY {sql_hash32(sql_hash_key('doc_id', 'window_no'))}, doc_id, window_no) - 1 AS sample_no FROM ws) "
            "SELECT doc_id, window_no, sample_no, sample_no // 8 AS batch_no, CAST(sample_no % 8 AS INTEGER) AS slot FROM ns"),
        "scored_documents": (
            f"WITH {maps_cte()}, {rewrite_ctes()}, "
            + redact_sql(("email", "phone", "url"), "SELECT doc_id, t3 AS text FROM r3w").removeprefix("WITH ")),
        "training_samples": (
            f"WITH {notes_tagged_cte()}, tw AS (SELECT doc_id, CAST(pos // 510 AS INTEGER) AS window_no, pos, label "
            f"FROM tagged), ws AS (SELECT doc_id, window_no, CAST(least(count(*), 512) AS INTEGER) AS mask_sum, "
            f"coalesce(string_agg(CAST(CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABEL2ID.items())
            + " END AS VARCHAR), ' ' ORDER BY pos) FILTER (WHERE label <> 'O'), '') AS targets_text FROM tw "
            "GROUP BY doc_id, window_no), "
            f"wsh AS (SELECT *, CAST({sql_hash32(sql_hash_key('doc_id', 'window_no'))} % 1024 AS INTEGER) AS shard FROM ws) "
            "SELECT doc_id, window_no, shard, CAST((row_number() OVER (PARTITION BY shard ORDER BY doc_id, window_no) - 1) "
            "// 8 AS INTEGER) AS batch_no, mask_sum, targets_text FROM wsh"),
        "label_encode": (
            f"WITH {notes_tagged_cte()} SELECT n.doc_id, coalesce(string_agg(CAST(CASE label " +
            " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABEL2ID.items()) +
            " END AS VARCHAR), ' ' ORDER BY pos), '') AS targets_text FROM notes n LEFT JOIN tagged t ON t.doc_id = n.doc_id "
            "GROUP BY n.doc_id"),
    }


def io_sql() -> dict[str, str]:
    return {
        "pages_to_documents": (
            "SELECT conv_id AS doc_id, coalesce(string_agg(text || chr(10), '' ORDER BY turn) "
            "FILTER (WHERE length(text) > 0), '') AS text FROM conversations GROUP BY conv_id"),
        "paragraphs": (
            f"WITH r AS ({redact_sql(('email',), DOCUMENTS_SQL)}) SELECT doc_id, "
            f"CAST(unnest(range(0, len(string_split(redacted_text, chr(10))))) AS INTEGER) AS para_no, "
            f"unnest(string_split(redacted_text, chr(10))) AS para FROM r"),
        "source_union": (
            f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, 'documents' AS format FROM documents UNION ALL "
            f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, 'pages' AS format FROM ({PAGE_TEXTS_SQL}) p"),
    }
