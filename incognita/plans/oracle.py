"""SQL counterparts of the registered queries, for an engine of its own.

Written by hand from the rules, not derived from the library: word lists, patterns
and formulas are stated here a second time, so that a slip on either side shows.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# --- word lists, as SQL ---------------------------------------------------
FIRST = (
    "['Anton','Berta','Clemens','Dora','Emil','Frieda','Gustav','Hedwig','Ida','Jakob','Klara','Ludwig',"
    "'Mathilde','Norbert','Ottilie','Paul','Quirin','Rosa','Siegfried','Thea','Ulrich','Viktoria',"
    "'Wilhelm','Xaver','Yvonne','Zeno','Jörg','Käthe','Björn','Änne','Günter','Sören']"
)
STEM = (
    "['Acker','Birken','Dorn','Eich','Feld','Gersten','Hage','Kalt','Linden','Moor','Nuss','Ober',"
    "'Pfeil','Reben','Stein','Tannen','Ufer','Vogel','Wald','Zander']"
)
ENDING = "['mann','meier','bauer','hofer','wirth','müller','berger','bach','huber','schmied']"
STREET_STEM = (
    "['Ahorn','Buchen','Dorf','Erlen','Fichten','Garten','Heide','Kirch','Linden','Markt',"
    "'Nelken','Park','Quell','Rosen','Schul','Tal']"
)
STREET_ENDING = "['straße','weg','allee','gasse','platz','ring']"
CITY_STEM = (
    "['Alten','Brunn','Eber','Fried','Grün','Hohen','Königs','Lauter','Mühl','Neuen',"
    "'Ober','Rothen','Schön','Unter','Weiden','Wolfs']"
)
CITY_ENDING = "['burg','berg','dorf','feld','hausen','heim','stadt','tal']"
COUNTRY = (
    "['Deutschland','Österreich','Schweiz','Frankreich','Italien','Spanien','Portugal','Polen',"
    "'Tschechien','Ungarn','Dänemark','Schweden','Norwegen','Finnland','Belgien','Niederlande',"
    "'Luxemburg','Irland','Griechenland','Kroatien']"
)
LEGAL = "['GmbH','AG','KG','OHG','e.V.','GmbH & Co. KG']"
WORD = (
    "['amsel','birke','distel','efeu','farn','ginster','hafer','iris','jasmin','klee','lupine','mohn',"
    "'nelke','olive','primel','quitte','raps','salbei','tulpe','ulme','veilchen','wicke','ysop','zeder']"
)
TLD = "['example','test','invalid']"
MAIL = "['example.test','example.invalid','example.local']"


# --- fakes, as SQL --------------------------------------------------------
def md(kind: str, v: str, seed: str = "incognita") -> str:
    return f"md5(concat_ws('|', '{seed}', '{kind}', {v}))"


def num(d: str, slot: int, n: int) -> str:
    return f"(('0x' || substr({d}, {8 * slot + 1}, 8))::BIGINT % {n})"


def word(d: str, slot: int, words: str, n: int) -> str:
    return f"({words})[{num(d, slot, n)} + 1]"


def two(d: str, first: int) -> str:
    return f"('0x' || substr({d}, {first}, 2))::INT::VARCHAR"


def _last(d: str) -> str:
    return f"({word(d, 1, STEM, 20)} || {word(d, 2, ENDING, 10)})"


def _local(d: str) -> str:
    whole = f"{word(d, 0, FIRST, 32)} || '.' || {_last(d)}"
    return f"regexp_replace(lower({whole}), '[^a-z0-9._-]', '', 'g')"


def _birthdate(d: str, v: str) -> str:
    shift = f"((30 + {num(d, 0, 336)}) * CASE {num(d, 1, 2)} WHEN 1 THEN 1 ELSE -1 END)::INT"
    german = (
        f"CASE WHEN regexp_full_match({v}, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') "
        f"THEN try_strptime({v}, '%d.%m.%Y')::DATE END"
    )
    other = f"DATE '1970-01-01' + {num(d, 2, 20000)}::INT"
    return (
        f"CASE WHEN ({german}) IS NOT NULL THEN strftime(({german}) + {shift}, '%d.%m.%Y') "
        f"ELSE strftime(coalesce(try_cast({v} AS DATE) + {shift}, {other}), '%Y-%m-%d') END"
    )


def _iban(d: str) -> str:
    account = f"lpad({num(d, 0, 1000000000)}::VARCHAR, 9, '0') || lpad({num(d, 1, 1000000000)}::VARCHAR, 9, '0')"
    check = f"98 - ({account} || '131400')::HUGEINT % 97"
    return f"'DE' || lpad(({check})::VARCHAR, 2, '0') || {account}"


def fake(kind: str, v: str, seed: str = "incognita") -> str:
    d = md(kind, v, seed)
    letters = f"translate(substr({d}, 1, 6), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"
    site = f"{word(d, 0, WORD, 24)} || '.' || {word(d, 1, TLD, 3)}"
    company = f"{_last(d)} || ' ' || {word(d, 3, LEGAL, 6)}"
    table = {
        "first_name": word(d, 0, FIRST, 32),
        "last_name": _last(d),
        "full_name": f"{word(d, 0, FIRST, 32)} || ' ' || {_last(d)}",
        "email": f"{_local(d)} || '@' || {word(d, 3, MAIL, 3)}",
        "username": _local(d),
        "phone": f"'+49 ' || (100 + {num(d, 0, 900)}) || ' ' || lpad({num(d, 1, 10000000)}::VARCHAR, 7, '0')",
        "street": f"{word(d, 0, STREET_STEM, 16)} || {word(d, 1, STREET_ENDING, 6)}",
        "house_number": f"(1 + {num(d, 0, 199)})::VARCHAR",
        "postcode": f"lpad((1 + {num(d, 0, 99999)})::VARCHAR, 5, '0')",
        "city": f"{word(d, 0, CITY_STEM, 16)} || {word(d, 1, CITY_ENDING, 8)}",
        "country": word(d, 0, COUNTRY, 20),
        "birthdate": _birthdate(d, v),
        "age": f"(18 + {num(d, 0, 63)})::VARCHAR",
        "iban": _iban(d),
        "bic": f"substr({letters}, 1, 4) || 'DE' || substr({letters}, 5, 2) || 'XXX'",
        "bank": company,
        "company": company,
        "password": f"substr(to_base64(unhex(sha256({d}))), 1, (12 + {num(d, 0, 9)})::INT)",
        "ip": " || '.' || ".join(two(d, p) for p in (1, 3, 5, 7)),
        "ipv6": " || ':' || ".join(f"substr({d}, {p}, 4)" for p in range(1, 33, 4)),
        "mac": "upper(" + " || ':' || ".join(f"substr({d}, {p}, 2)" for p in range(1, 13, 2)) + ")",
        "domain": site,
        "url": f"'https://' || {site}",
        "ssn": f"(100000000 + {num(d, 0, 900000000)})::VARCHAR",
        "tax_id": f"(100000 + {num(d, 0, 900000)})::VARCHAR || lpad({num(d, 1, 100000)}::VARCHAR, 5, '0')",
        "uuid": (
            f"substr({d},1,8) || '-' || substr({d},9,4) || '-' || substr({d},13,4) || '-' || "
            f"substr({d},17,4) || '-' || substr({d},21,12)"
        ),
    }
    return "(" + table.get(kind, word(d, 0, WORD, 24)) + ")"


# --- shared inputs, as SQL ------------------------------------------------
PEOPLE = """
SELECT c_custkey AS id, c_name AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'admin@example.com'
       ELSE lower(replace(c_name, '#', '.')) || '@mail.example.com' END AS email,
  CASE WHEN c_custkey % 5 = 0 THEN ''
       ELSE '+49 ' || (c_nationkey + 100) || ' ' || (c_custkey + 100000) END AS phone,
  CASE WHEN c_custkey % 2 = 0 THEN strftime(DATE '1940-01-01' + (c_custkey * 37 % 25000)::INT, '%Y-%m-%d')
       WHEN c_custkey % 13 = 0 THEN 'unknown'
       ELSE strftime(DATE '1940-01-01' + (c_custkey * 37 % 25000)::INT, '%d.%m.%Y') END AS birthdate,
  'City ' || c_nationkey AS city,
  lpad((c_custkey * 7919 % 99999)::VARCHAR, 5, '0') AS zip,
  (18 + c_custkey % 70)::INT AS age, c_mktsegment AS segment, c_acctbal AS balance
FROM customer"""

FIRMS = """
SELECT s_suppkey AS id, s_name AS company, 'City ' || s_nationkey AS city,
  'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') AS name
FROM supplier"""

ORDER_TEXT = """
SELECT o_orderkey AS id,
  'Bestellung vom ' || strftime(o_orderdate, '%d.%m.%Y') || ' bzw. ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  || ', ü' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || ' Ort, Tel: +49 30-' || (o_orderkey + 1000000)
  || ' ' || chr(10) || ' Kunde' || o_custkey || '@shop-' || (o_custkey % 10) || '.example.com von 10.'
  || (o_orderkey % 256) || '.' || (o_orderkey % 300) || '.7 https://www.example.com/o/' || o_orderkey
  || '?a=1 IBAN DE89 3704 0044 0532 0130 00AB 12 ' || substr(md5(o_orderkey::VARCHAR), 1, 8)
  || '-' || substr(md5(o_orderkey::VARCHAR), 9, 4) || '-4000-8000-' || substr(md5(o_orderkey::VARCHAR), 13, 12)
  || ' fe80:0:0:0:' || substr(md5(o_orderkey::VARCHAR), 1, 4) || ':0:0:1 ende' AS text
FROM orders"""

LABELS = """
SELECT c_custkey AS key,
  (['Users','customers','orders','Accounts','clients','misc','LEADS'])[c_nationkey % 7 + 1] AS "table",
  (['First Name','E-Mail','PLZ','c_name','Tax-ID','geburtsdatum','age','Alter','IP Address','customer_id',
    'konto'])[c_custkey % 11 + 1] AS "column"
FROM customer"""

# verdict per label, spelled out
VERDICTS = f"""
SELECT key, "table", "column",
  CASE "column" WHEN 'First Name' THEN 'first_name' WHEN 'E-Mail' THEN 'email' WHEN 'PLZ' THEN 'postcode'
    WHEN 'Tax-ID' THEN 'tax_id' WHEN 'geburtsdatum' THEN 'birthdate' WHEN 'age' THEN 'age'
    WHEN 'Alter' THEN 'age' WHEN 'IP Address' THEN 'ip' WHEN 'customer_id' THEN 'uuid'
    WHEN 'konto' THEN 'iban' END AS type,
  CASE "column" WHEN 'First Name' THEN 'firstName' WHEN 'E-Mail' THEN 'safeEmail' WHEN 'PLZ' THEN 'postcode'
    WHEN 'Tax-ID' THEN 'randomNumber' WHEN 'geburtsdatum' THEN 'date' WHEN 'age' THEN 'numberBetween'
    WHEN 'Alter' THEN 'numberBetween' WHEN 'IP Address' THEN 'ipv4' WHEN 'customer_id' THEN 'uuid'
    WHEN 'konto' THEN 'iban' END AS faker_method,
  round(CASE "column" WHEN 'c_name' THEN 0 WHEN 'age' THEN 5 WHEN 'Alter' THEN 5 WHEN 'customer_id' THEN 6
    WHEN 'konto' THEN 8 ELSE 10 END::DOUBLE
    * CASE lower("table") WHEN 'users' THEN 1.5 WHEN 'customers' THEN 1.5 WHEN 'accounts' THEN 1.3
      WHEN 'clients' THEN 1.4 WHEN 'orders' THEN 1.2 WHEN 'leads' THEN 1.3 ELSE 1.0 END::DOUBLE, 1) AS score
FROM ({LABELS})"""

KEEP_ADMIN = (
    "coalesce(contains(lower({v}),'admin') OR contains(lower({v}),'city 7') "
    "OR contains(lower({v}),'enterprise-unknown') OR contains('admin',lower({v})) "
    "OR contains('city 7',lower({v})) OR contains('enterprise-unknown',lower({v})), false)"
)


def kept(v: str) -> str:
    return KEEP_ADMIN.replace("{v}", v)


def cell(kind: str, v: str, text: str | None = None) -> str:
    """A cell under KEEP_ADMIN."""
    text = text or v
    return f"CASE WHEN {v} IS NULL OR {kept(text)} THEN {text} ELSE {fake(kind, text)} END"


# --- sources and sinks ----------------------------------------------------
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ),
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}

ORACLE["list_tables"] = " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in COLUMNS
)
ORACLE["table_columns"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS ordinal, "
    f"{str(c in ('o_orderkey', 'c_custkey')).lower()} AS \"primary\", count({c}) AS filled FROM {t}"
    for t, names in COLUMNS.items()
    for i, c in enumerate(names.split(), start=1)
)
ORACLE["read_csv_sniffed"] = f"""
SELECT id::VARCHAR AS id, name, coalesce(email, '') AS email, phone, birthdate, city, zip,
  age::VARCHAR AS age, segment, balance::VARCHAR AS balance FROM ({PEOPLE})"""
ORACLE["write_csv"] = f"""
SELECT id || '|' || name || '|"say ""' || segment || '"" | ' || city || '"|' || phone AS line
FROM ({PEOPLE})"""
ORACLE["read_json"] = """
SELECT o_orderkey AS order_id, 'Firma ' || (o_custkey % 50) AS company,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || o_custkey || '@example.com' END AS email,
  o_custkey % 90000 + 10000 AS zip, (o_custkey + 2)::VARCHAR AS phone, 2 AS mails
FROM orders"""
ORACLE["write_json"] = f"""
SELECT '{{"id":' || id || ',"email":' || coalesce('"' || email || '"', 'null')
  || ',"address":{{"straße":"Straße ' || city || '","age":' || age || '}}}}' AS line
FROM ({PEOPLE})"""
ORACLE["read_insert_dump"] = """
SELECT o_orderkey::VARCHAR AS o_orderkey,
  CASE WHEN o_custkey % 9 <> 0 THEN o_custkey::VARCHAR END AS o_custkey,
  'it''s; (' || o_orderpriority || ') "\\' AS note
FROM orders"""
ORACLE["to_insert_statements"] = f"""
SELECT 'users' AS "table", '(''' || id || ''', ''' || name || ''', ' || coalesce('''' || email || '''', 'NULL')
  || ', ''' || age || ''', ''' || balance || ''')' AS "tuple"
FROM ({PEOPLE})"""
ORACLE["read_text"] = "SELECT substr(text, 1, 500) AS sample, length(text) AS chars FROM documents"
ORACLE["write_table"] = f"""
SELECT id, {fake('full_name', 'name')} AS name, {fake('age', 'age::VARCHAR')}::INT AS age, balance
FROM ({PEOPLE})"""
ORACLE["count_rows"] = "SELECT count(*) AS row_count FROM lineitem"
ORACLE["fetch_batch"] = """
SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100"""
ORACLE["fetch_after"] = """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50"""

# --- detection ------------------------------------------------------------
ORACLE["normalize_name"] = f"""
SELECT key, lower(replace(replace("table" || '-' || "column", '-', '_'), ' ', '_')) AS normalized
FROM ({LABELS})"""
ORACLE["detect_columns"] = f"""
SELECT key, "column", type IS NOT NULL AS detected, type, faker_method, score,
  CASE WHEN type IS NOT NULL THEN 'column_name' END AS method,
  CASE WHEN type IS NOT NULL THEN 'pseudonymize' ELSE 'keep' END AS action
FROM ({VERDICTS})"""
ORACLE["context_score"] = f"""
SELECT "table", "column", max(score) AS score, count(*) AS n FROM ({VERDICTS}) GROUP BY ALL"""
ORACLE["score_band"] = f"""
SELECT key, score, CASE WHEN score >= 9 THEN 'high' WHEN score >= 6 THEN 'medium' ELSE 'low' END AS band
FROM ({VERDICTS})"""
ORACLE["available_types"] = f"""
WITH t(type, faker_method) AS (VALUES
  ('first_name','firstName'), ('last_name','lastName'), ('full_name','name'), ('email','safeEmail'),
  ('phone','phoneNumber'), ('street','streetAddress'), ('house_number','buildingNumber'),
  ('postcode','postcode'), ('city','city'), ('country','country'), ('birthdate','date'),
  ('age','numberBetween'), ('iban','iban'), ('bic','swiftBicNumber'), ('bank','company'),
  ('company','company'), ('username','userName'), ('password','password'), ('ip','ipv6'),
  ('mac','macAddress'), ('domain','domainName'), ('url','url'), ('ssn','randomNumber'),
  ('tax_id','randomNumber'), ('uuid','uuid'))
SELECT t.type, t.faker_method, count(v.key) AS cells
FROM t LEFT JOIN ({VERDICTS}) v ON v.type = t.type GROUP BY ALL"""
ORACLE["analyze_schema"] = """
WITH v("table", "column", type, faker_method, score) AS (VALUES
  ('customers','name','full_name','name',12.0), ('customers','email','email','safeEmail',15.0),
  ('customers','phone','phone','phoneNumber',15.0), ('customers','birthdate','birthdate','date',15.0),
  ('customers','city','city','city',15.0), ('customers','zip','postcode','postcode',15.0),
  ('customers','age','age','numberBetween',7.5), ('supplier','company','company','company',8.0),
  ('supplier','city','city','city',10.0), ('supplier','name','full_name','name',8.0),
  ('pages','url','url','url',7.0)),
n AS (SELECT 'customers' AS "table", count(*) AS row_count FROM customer
  UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'pages', count(*) FROM pages)
SELECT v."table", v."column", type, faker_method, score::DOUBLE AS score, 'column_name' AS method,
  'pseudonymize' AS action, row_count
FROM v JOIN n ON n."table" = v."table\""""
ORACLE["profile_sheet"] = """
WITH v(sheet, "column", type, score) AS (VALUES
  ('Customers','name','full_name',12.0), ('Customers','email','email',15.0),
  ('Customers','phone','phone',15.0), ('Customers','birthdate','birthdate',15.0),
  ('Customers','city','city',15.0), ('Customers','zip','postcode',15.0), ('Customers','age','age',7.5),
  ('Suppliers','company','company',8.0), ('Suppliers','city','city',10.0),
  ('Suppliers','name','full_name',8.0)),
n AS (SELECT 'Customers' AS sheet, count(*) AS row_count FROM customer
  UNION ALL SELECT 'Suppliers', count(*) FROM supplier)
SELECT v.sheet, v."column", type, score::DOUBLE AS score, row_count FROM v JOIN n ON n.sheet = v.sheet"""

# --- patterns -------------------------------------------------------------
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IBAN = r"[A-Z]{2}\d{2}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{4}[\s]?[A-Z0-9]{2}"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
URL = r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)"
PATTERNS = [  # type, weight, regex, fake type
    ("email", 10, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email"),
    ("phone_de", 9, r"(?:\+49|0)[\s\-]?[\d\s\-]{6,20}", "phone"),
    ("iban", 10, IBAN, "iban"),
    ("ipv4", 10, rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", "ip"),
    ("ipv6", 10, "(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", "ip"),
    ("url", 8, URL, "url"),
    ("uuid", 7, UUID, "uuid"),
    ("postcode_de", 7, r"\b\d{5}\b", "postcode"),
    ("date_iso", 6, r"\d{4}-\d{2}-\d{2}", "birthdate"),
    ("date_de", 6, r"\d{2}\.\d{2}\.\d{4}", "birthdate"),
]
DOCUMENT = [
    ("email", 0, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "email"),
    ("phone", 0, r"\b(?:\+49|0)[\s\-/]?[\d\s\-/]{6,20}\b", "phone"),
    ("iban", 0, rf"\b{IBAN}\b", "iban"),
    ("ipv4", 0, rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", "ip"),
    ("url", 0, rf"\b{URL}\b", "url"),
    ("uuid", 0, rf"\b{UUID}\b", "uuid"),
]


def only(*types: str) -> list[tuple]:
    return [p for t in types for p in PATTERNS if p[0] == t]


def finds(source: str, key: str, patterns: list[tuple] = PATTERNS) -> str:
    """(key, ord, type, score, start, end, value) of every match."""
    parts = []
    for i, (kind, weight, regex, _) in enumerate(patterns):
        parts.append(
            f"""SELECT {key}, {i} AS ord, '{kind}' AS type, {weight} AS score, n,
  regexp_extract_all(text, '{regex}') AS ms, string_split_regex(text, '{regex}') AS gaps
FROM ({source}) s, LATERAL (SELECT unnest(range(1, len(regexp_extract_all(s.text, '{regex}')) + 1)) AS n)"""
        )
    return f"""SELECT {key}, ord, type, score,
  (list_sum(list_transform(gaps[1:n], lambda g: length(g)))
   + coalesce(list_sum(list_transform(ms[1:n-1], lambda m: length(m))), 0))::INT AS start,
  (list_sum(list_transform(gaps[1:n], lambda g: length(g)))
   + list_sum(list_transform(ms[1:n], lambda m: length(m))))::INT AS "end",
  ms[n] AS value
FROM ({' UNION ALL '.join(parts)})"""


def survivors(source: str, key: str, patterns: list[tuple] = PATTERNS) -> str:
    """WITH clauses ending in ``won``: matches left after overlap resolution."""
    return f"""WITH RECURSIVE src AS ({source}),
found AS MATERIALIZED ({finds('SELECT * FROM src', key, patterns)}),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start DESC, ord) AS rn FROM found),
walk AS (
  SELECT {key}, rn, start FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.{key}, r.rn, r.start FROM ranked r JOIN (
    SELECT w.{key}, min(c.rn) AS rn FROM walk w JOIN ranked c
      ON c.{key} = w.{key} AND c.rn > w.rn AND c."end" <= w.start GROUP BY w.{key}) nx
    ON r.{key} = nx.{key} AND r.rn = nx.rn),
won AS (SELECT r.* FROM ranked r JOIN walk w ON w.{key} = r.{key} AND w.rn = r.rn)"""


def pattern_fake(patterns: list[tuple]) -> str:
    arms = " ".join(f"WHEN '{kind}' THEN {fake(target, 'value')}" for kind, _, _, target in patterns)
    return f"CASE type {arms} END"


def replaced_text(source: str, key: str, patterns: list[tuple] = PATTERNS, keep: str = "false") -> str:
    return f"""{survivors(source, key, patterns)},
faked AS (SELECT {key}, start, "end", CASE WHEN {keep} THEN value ELSE {pattern_fake(patterns)} END AS fake,
  coalesce(lag("end") OVER (PARTITION BY {key} ORDER BY start), 0) AS before FROM won),
glued AS (SELECT f.{key}, string_agg(substr(text, before + 1, start - before) || fake, '' ORDER BY start) AS head,
  max("end") AS last FROM faked f JOIN src ON src.{key} = f.{key} GROUP BY f.{key})
SELECT s.{key}, CASE WHEN g.{key} IS NULL THEN s.text ELSE g.head || substr(s.text, g.last + 1) END AS text
FROM src s LEFT JOIN glued g ON g.{key} = s.{key}"""


DOCS = "SELECT doc_id, text FROM documents"
PAGES = "SELECT page_id, url || ' ' || html AS text FROM pages"
FINDING = 'start, "end", type, value, score'

ORACLE["find_all"] = f"SELECT doc_id, {FINDING} FROM ({finds(DOCS, 'doc_id')})"
ORACLE["find_all_enriched"] = f"SELECT id, {FINDING} FROM ({finds(ORDER_TEXT, 'id')})"
ORACLE["find_all_pages"] = f"SELECT page_id, {FINDING} FROM ({finds(PAGES, 'page_id')})"
ORACLE["findings_by_type"] = f"""
SELECT type, count(*) AS findings, count(DISTINCT doc_id) AS documents, max(score) AS score
FROM ({finds(DOCS, 'doc_id')}) GROUP BY type"""
ORACLE["distinct_findings"] = f"""
SELECT DISTINCT type, value, score,
  CASE WHEN length(value) > 30 THEN substr(value, 1, 30) || '...' ELSE value END AS display,
  CASE WHEN score >= 9 THEN 'high' WHEN score >= 6 THEN 'medium' ELSE 'low' END AS band
FROM ({finds(ORDER_TEXT, 'id')})"""
ORACLE["preserved_findings"] = f"""
SELECT doc_id, {FINDING},
  contains(lower(value), 'mail1.example.com') OR contains(value, '10.') OR contains(value, '0') AS preserved
FROM ({finds(DOCS, 'doc_id')})"""
ORACLE["detect_value"] = f"""
WITH lines AS (SELECT doc_id, unnest(range(len(parts))) AS line, parts FROM
  (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
hit AS (SELECT doc_id, line, CASE {' '.join(
    f"WHEN regexp_matches(parts[line + 1], '{regex}') THEN '{kind}'" for kind, _, regex, _ in PATTERNS
)} END AS type FROM lines)
SELECT doc_id, line, type, CASE type {' '.join(f"WHEN '{kind}' THEN {w}" for kind, w, _, _ in PATTERNS)} END AS score,
  'regex' AS method FROM hit WHERE type IS NOT NULL"""
ORACLE["scan_cells"] = f"""
WITH cells AS (
  SELECT id, 'name' AS "column", name AS value FROM ({PEOPLE}) UNION ALL
  SELECT id, 'email', email FROM ({PEOPLE}) UNION ALL SELECT id, 'phone', phone FROM ({PEOPLE}) UNION ALL
  SELECT id, 'birthdate', birthdate FROM ({PEOPLE}) UNION ALL SELECT id, 'city', city FROM ({PEOPLE}) UNION ALL
  SELECT id, 'zip', zip FROM ({PEOPLE}) UNION ALL SELECT id, 'segment', segment FROM ({PEOPLE})),
hit AS (SELECT *, CASE {' '.join(
    f"WHEN regexp_matches(value, '{regex}') THEN '{kind}'" for kind, _, regex, _ in PATTERNS
)} END AS type FROM cells)
SELECT 'customers' AS sheet, id AS "row", "column", type, value,
  CASE type {' '.join(f"WHEN '{kind}' THEN {w}" for kind, w, _, _ in PATTERNS)} END AS score
FROM hit WHERE type IS NOT NULL"""
ORACLE["doc_pattern_findings"] = f"""
SELECT id, type, value, start AS position, 'regex' AS method, 'pseudonymize' AS action
FROM ({finds(ORDER_TEXT, 'id', DOCUMENT)})"""
ORACLE["document_profile"] = f"""
SELECT doc_id, {' + '.join(f"len(regexp_extract_all(text, '{regex}'))" for _, _, regex, _ in DOCUMENT)}
  AS total_findings, length(text) AS text_length FROM documents"""

# --- JSON -----------------------------------------------------------------
ORACLE["json_keys"] = """
SELECT key, documents FROM (SELECT unnest(['customer','contacts','mail','company','order_id','id','name',
  'address','login','street','zip','status','phone']) AS key), (SELECT count(*) AS documents FROM orders)
UNION ALL SELECT 'email', count(*) FROM orders WHERE o_orderkey % 7 <> 0"""
ORACLE["json_keys_events"] = """
SELECT key, count(*) AS documents FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key"""
ORACLE["detect_json_keys"] = """
WITH v("column", type, score) AS (VALUES ('customer',NULL,0.0), ('contacts',NULL,0.0), ('mail','email',9.0),
  ('company','company',8.0), ('order_id',NULL,0.0), ('id',NULL,0.0), ('name','full_name',8.0),
  ('address','street',9.0), ('login','username',8.0), ('street','street',10.0), ('zip','postcode',10.0),
  ('status',NULL,0.0), ('phone','phone',10.0), ('email','email',10.0))
SELECT "column", type IS NOT NULL AS detected, type, score::DOUBLE AS score,
  CASE WHEN type IS NULL THEN 'keep' ELSE 'pseudonymize' END AS action FROM v"""
ORACLE["json_preview"] = """
SELECT '{"order_id":' || o_orderkey || ',"long":"' || substr(repeat('Firma ' || (o_custkey % 50), 8), 1, 50)
  || '...","customer":{"id":' || o_orderkey || ',"name":"Name ' || o_custkey || '"'
  || CASE WHEN o_orderkey % 7 <> 0 THEN ',"email":"c' || o_custkey || '@example.com"' ELSE '' END
  || ',"address":{"street":"Weg ' || (o_custkey % 90) || '","zip":' || (o_custkey % 90000 + 10000)
  || '},"login":' || (o_orderkey % 2 = 0) || '},"contacts":["[array mit 2 Elementen]"],'
  || '"mail":["[array mit 2 Elementen]"],"...":"..."}' AS preview
FROM orders"""
ORACLE["pseudonymize_json"] = f"""
WITH o AS (SELECT *, 'Firma ' || (o_custkey % 50) AS firm, 'Name ' || o_custkey AS nm,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || o_custkey || '@example.com' END AS em,
  'Weg ' || (o_custkey % 90) AS st, (o_custkey % 90000 + 10000)::VARCHAR AS z,
  (o_custkey + 1)::VARCHAR AS p1, (o_custkey + 2)::VARCHAR AS p2 FROM orders)
SELECT o_orderkey AS order_id, {fake('company', 'firm')} AS company, o_orderkey AS id,
  {fake('full_name', 'nm')} AS name, CASE WHEN em IS NOT NULL THEN {fake('email', 'em')} END AS email,
  o_orderkey % 2 = 0 AS login, {fake('street', 'st')} AS street, {fake('postcode', 'z')} AS zip,
  o_orderstatus AS status, {fake('phone', 'p1')} AS phone, {fake('phone', 'p2')} AS phone2,
  o_orderpriority || '+x' AS mail
FROM o"""
ORACLE["pseudonymize_json_documents"] = f"""
SELECT order_id, company, name, email, street, zip, status, phone, phone2, replace(mail, '+x', '') AS mail
FROM ({ORACLE["pseudonymize_json"]})"""
ORACLE["pseudonymize_json_text"] = f"""
SELECT event_id, user_id, '{{"k": "' || {fake('username', "json_extract_string(props, '$.k')")} || '"}}' AS props
FROM events"""

# --- preserve rules -------------------------------------------------------
VALUES = f"""
SELECT key, CASE key % 10 WHEN 0 THEN 'Admin' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'no-reply+' || key
  WHEN 4 THEN 'min' WHEN 5 THEN 'TEST' || key ELSE "table" || '/' || "column" END AS value
FROM ({LABELS})"""


def listed(v: str, *rules: str, both_ways: bool = True) -> str:
    tests = [f"contains({v}, '{r}')" for r in rules]
    if both_ways:
        tests += [f"contains('{r}', {v})" for r in rules]
    return f"coalesce({' OR '.join(tests)}, false)"


ORACLE["parse_preserve_rules"] = f"""
SELECT key, {listed('lower(value)', 'root', 'leads/age', 'orders')} AS by_json,
  {listed('lower(value)', 'root', 'leads/age', 'orders')} AS by_list FROM ({VALUES})"""
ORACLE["should_preserve"] = f"""
SELECT key, {listed('lower(value)', 'admin', 'orders/', 'no-reply')} AS compat,
  {listed('lower(value)', 'admin', 'orders/', 'no-reply', both_ways=False)} AS strict,
  {listed('value', 'Admin', 'orders/', 'no-reply')} AS exact_case,
  coalesce(lower(value) LIKE '%/age' OR lower(value) LIKE 'test%5', false) AS glob,
  false AS no_rules FROM ({VALUES})"""
ORACLE["edit_preserve_rules"] = f"SELECT key, {listed('lower(value)', 'test', 'x1')} AS kept FROM ({VALUES})"
DEFAULT_WORDS = (
    "admin administrator root system guest anonymous null test demo support noreply no-reply postmaster "
    "webmaster hostmaster abuse info sales marketing help contact"
)
ORACLE["default_preserve_rules"] = f"""
SELECT key, {listed('lower(value)', *DEFAULT_WORDS.split())} AS kept FROM ({VALUES})"""
ORACLE["mark_preserved"] = """
WITH rules AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS rule FROM part),
vals AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(substr(p_name, 2, 3)) WHEN 1 THEN p_type
  ELSE p_type || ' ' || p_name END AS value FROM part)
SELECT p_partkey, value, EXISTS (SELECT 1 FROM rules
  WHERE contains(lower(value), rule) OR contains(rule, lower(value))) AS preserved
FROM vals"""

# --- fakes ----------------------------------------------------------------
for _kind in (
    "first_name last_name full_name email phone street house_number postcode city country birthdate age iban "
    "bic bank company username password ip ipv6 mac domain url ssn tax_id uuid word"
).split():
    _from = "birthdate" if _kind == "birthdate" else "name"
    ORACLE[f"fake_{_kind}"] = f"SELECT id, {fake(_kind, _from)} AS fake FROM ({PEOPLE})"
ORACLE["fake_unknown_type"] = f"SELECT id, {fake('shoe_size', 'name')} AS fake FROM ({PEOPLE})"
ORACLE["fake_preserved"] = f"SELECT id, {cell('email', 'email')} AS email FROM ({PEOPLE})"
ORACLE["fake_seeded"] = f"""
SELECT id, {fake('city', 'city', 'one')} AS one, {fake('city', 'city', 'two')} AS two FROM ({PEOPLE})"""

CUSTOMER_TYPES = {
    "name": "full_name",
    "email": "email",
    "phone": "phone",
    "birthdate": "birthdate",
    "city": "city",
    "zip": "postcode",
    "age": "age",
}
SUPPLIER_TYPES = {"company": "company", "city": "city", "name": "full_name"}
PAIRS = " UNION ALL ".join(
    [f"SELECT '{t}' AS type, {c}::VARCHAR AS original FROM ({PEOPLE})" for c, t in CUSTOMER_TYPES.items()]
    + [f"SELECT '{t}', {c} FROM ({FIRMS})" for c, t in SUPPLIER_TYPES.items()]
)
ALL_PAIRS = f"SELECT * FROM ({PAIRS}) WHERE original IS NOT NULL AND NOT {kept('original')}"
_arms = " ".join(
    f"WHEN '{t}' THEN {fake(t, 'original')}"
    for t in ("full_name", "email", "phone", "birthdate", "city", "postcode", "age", "company")
)
ORACLE["build_mapping"] = f"""
SELECT DISTINCT type, original, CASE type {_arms} END AS fake FROM ({ALL_PAIRS})"""
# numbers without gaps: originals in order of their bucket, then of themselves
NUMBERED = f"row_number() OVER (PARTITION BY type ORDER BY {num(md('bucket', 'original'), 0, 4096)}, original) - 1"


def feistel(kind: str, source: str, no: str, a: int, b: int) -> str:
    """``source`` with ``no`` sent through four rounds over a x b cells."""

    def drawn(i: int, v: str) -> str:
        return f"('0x' || substr(md5('incognita|permuted {kind}|{i}:' || {v}), 1, 8))::BIGINT"

    return f"""(SELECT * EXCLUDE ({no}, l0, r0, l1, r1, l2), l2 * {b} + (r1 + {drawn(3, 'l2')}) % {b} AS {no} FROM (
  SELECT *, (l1 + {drawn(2, 'r1')}) % {a} AS l2 FROM (SELECT *, (r0 + {drawn(1, 'l1')}) % {b} AS r1 FROM (
    SELECT *, (l0 + {drawn(0, 'r0')}) % {a} AS l1 FROM (SELECT *, {no} // {b} AS l0, {no} % {b} AS r0 FROM {source}))))) """


ORACLE["build_mapping_unique"] = f"""
WITH p AS (
  SELECT DISTINCT 'email' AS type, o_orderkey::VARCHAR AS original FROM orders
  UNION SELECT 'last_name', o_custkey::VARCHAR FROM orders
  UNION SELECT 'last_name', o_orderpriority FROM orders),
n AS (SELECT *, {NUMBERED} AS no FROM p)
SELECT type, original, CASE type
  WHEN 'email' THEN replace({fake('email', 'original')}, '@', '-' || no || '@')
  ELSE {fake('last_name', 'original')} || '-' || no END AS fake FROM n"""
_ORDER_PAIRS = """SELECT DISTINCT 'email' AS type, o_orderkey::VARCHAR AS original FROM orders WHERE {0}
  UNION SELECT 'iban', o_custkey::VARCHAR FROM orders WHERE {0} UNION SELECT 'last_name', o_orderpriority FROM orders WHERE {0}"""
ORACLE["build_mapping_continued"] = f"""
WITH e AS ({_ORDER_PAIRS.format('o_custkey % 3 = 0')}),
l AS (SELECT * FROM ({_ORDER_PAIRS.format('true')}) x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.type = x.type AND e.original = x.original)),
n AS (SELECT *, {NUMBERED} AS no FROM e UNION ALL
  SELECT *, {NUMBERED} + (SELECT count(*) FROM e WHERE e.type = l.type) FROM l),
i AS (SELECT original, no AS x FROM {feistel('iban', "(SELECT * FROM n WHERE type = 'iban')", 'no', 10**9, 10**9)})
SELECT type, original, CASE type WHEN 'email' THEN replace({fake('email', 'original')}, '@', '-' || no || '@')
  ELSE {fake('last_name', 'original')} || '-' || no END AS fake FROM n WHERE type <> 'iban'
UNION ALL SELECT 'iban', original, 'DE' || lpad((98 - (x::HUGEINT * 1000000 + 131400) % 97)::VARCHAR, 2, '0') || lpad(x::VARCHAR, 18, '0') FROM i"""
ORACLE["preserve_one_character"] = """
WITH rules AS (SELECT DISTINCT lower(p_name) AS rule FROM part UNION SELECT '#'),
vals AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN substr(p_name, 3, 12)
  ELSE p_type || CASE WHEN p_partkey % 4 = 0 THEN '#' ELSE '+' END END AS value FROM part)
SELECT p_partkey, value, EXISTS (SELECT 1 FROM rules WHERE contains(lower(value), rule) OR contains(rule, lower(value))) AS preserved FROM vals"""


def reused(kind: str, v: str, source: str) -> str:
    known = f"EXISTS (SELECT 1 FROM ({FIRMS}) f WHERE f.{source} = p.{v})"
    return (
        f"CASE WHEN {kept('p.' + v)} THEN p.{v} WHEN {known} THEN {fake(kind, 'p.' + v, 'earlier')} "
        f"ELSE {fake(kind, 'p.' + v)} END"
    )


ORACLE["apply_mapping"] = f"""
SELECT id, {reused('full_name', 'name', 'name')} AS name, {reused('city', 'city', 'city')} AS city,
  {fake('age', 'age::VARCHAR')}::INT AS age, phone FROM ({PEOPLE}) p"""
ORACLE["mapping_stats"] = f"""
WITH t AS (SELECT count(*) AS total FROM ({ALL_PAIRS})),
d AS (SELECT count(*) AS misses FROM (SELECT DISTINCT type, original FROM ({ALL_PAIRS})))
SELECT total - misses AS hits, misses, total, round((total - misses) / total * 100, 2)::DOUBLE AS hit_rate,
  misses AS mapping_size FROM t, d"""
ORACLE["mapping_stats_lineitem"] = """
WITH t AS (SELECT count(l_suppkey) + count(l_returnflag) + count(l_linestatus) AS total,
  count(DISTINCT l_suppkey) + (SELECT count(*) FROM (SELECT l_returnflag FROM lineitem
    UNION SELECT l_linestatus FROM lineitem)) AS misses FROM lineitem)
SELECT total - misses AS hits, misses, total, round((total - misses) / total * 100, 2)::DOUBLE AS hit_rate,
  misses AS mapping_size FROM t"""

# --- applying -------------------------------------------------------------
FAKED_PEOPLE = f"""
SELECT id, {cell('full_name', 'name')} AS name, {cell('email', 'email')} AS email,
  {cell('phone', 'phone')} AS phone, {cell('birthdate', 'birthdate')} AS birthdate,
  {cell('city', 'city')} AS city, {cell('postcode', 'zip')} AS zip,
  ({cell('age', 'age', 'age::VARCHAR')})::INT AS age, segment, balance FROM ({PEOPLE})"""
ORACLE["pseudonymize_table"] = FAKED_PEOPLE
ORACLE["pseudonymize_stream"] = FAKED_PEOPLE
ORACLE["pseudonymize_csv"] = f"""
SELECT id::VARCHAR AS id, name, coalesce(email, '') AS email, phone, birthdate, city, zip, age::VARCHAR AS age,
  segment, balance::VARCHAR AS balance FROM ({FAKED_PEOPLE})"""
ORACLE["pseudonymize_lineitem"] = f"""
SELECT l_orderkey, l_linenumber, {fake('company', 'l_suppkey::VARCHAR')} AS l_suppkey,
  {fake('iban', 'l_partkey::VARCHAR')} AS l_partkey FROM lineitem"""
ORACLE["pseudonymize_tables"] = f"""
SELECT 'customers' AS "table", id, {fake('full_name', 'name')} AS name, {fake('city', 'city')} AS city
FROM ({PEOPLE}) UNION ALL
SELECT 'suppliers', id, {fake('full_name', 'name')}, {fake('city', 'city')} FROM ({FIRMS})"""
ORACLE["run_summary"] = f"""
WITH s AS (
  SELECT 'customers' AS "table", count(*) AS processed,
    count(*) FILTER (email IS NOT NULL AND NOT {kept('email')}) AS updated FROM ({PEOPLE})
  UNION ALL SELECT 'suppliers', count(*), count(*) FILTER (NOT {kept('company')} OR NOT {kept('city')}
    OR NOT {kept('name')}) FROM ({FIRMS})
  UNION ALL SELECT 'lineitem', 0, 0)
SELECT "table", processed, updated, 0 AS errors FROM s
UNION ALL SELECT '(all)', sum(processed)::BIGINT, sum(updated)::BIGINT, 0 FROM s"""
ORACLE["keep_rule"] = f"SELECT id, name, {fake('city', 'city')} AS city FROM ({PEOPLE})"
ORACLE["progress"] = f"""
SELECT count(*) AS processed, count(*) FILTER (email IS NOT NULL AND NOT {kept('email')}) AS updated,
  count(*) AS written FROM ({PEOPLE})"""
ORACLE["pseudonymize_insert_dump"] = f"""
SELECT id::VARCHAR AS id, {cell('full_name', 'name')} AS name, {cell('email', 'email')} AS email,
  {cell('city', 'city')} AS city FROM ({PEOPLE})"""
ORACLE["pseudonymize_sheets"] = f"""
SELECT id, CASE WHEN phone = '' THEN '' ELSE {cell('phone', 'phone')} END AS phone,
  {cell('city', 'city')} AS city, age FROM ({PEOPLE})"""
ORACLE["pseudonymize_text"] = replaced_text(DOCS, "doc_id")
ORACLE["pseudonymize_text_enriched"] = replaced_text(
    ORDER_TEXT, "id", keep="contains(lower(value), '@shop-3.example.com')"
)
ORACLE["pseudonymize_text_stream"] = replaced_text(DOCS, "doc_id", only("email", "ipv4"))
ORACLE["splice_replacements"] = replaced_text(ORDER_TEXT, "id", only("date_iso", "email"))
ORACLE["resolve_overlaps"] = f"""{survivors(ORDER_TEXT, 'id')}
SELECT id, start, "end", type, value FROM won"""
ORACLE["pattern_to_type"] = f"""{survivors(DOCS, 'doc_id')}
SELECT doc_id, start, type, {pattern_fake(PATTERNS)} AS fake FROM won"""


def _redacted() -> str:
    steps, before = [], ORDER_TEXT
    for kind, _, regex, target in DOCUMENT:
        name = f"after_{kind}"
        steps.append(
            f"""{name} AS MATERIALIZED (SELECT id, array_to_string(list_transform(range(1, len(g) + 1), lambda i:
  g[i] || CASE WHEN i <= len(m) THEN {fake(target, 'm[i]')} ELSE '' END), '') AS text
  FROM (SELECT id, regexp_extract_all(text, '{regex}') AS m, string_split_regex(text, '{regex}') AS g
        FROM ({before})))"""
        )
        before = f"SELECT * FROM {name}"
    return f"WITH {', '.join(steps)} {before}"


ORACLE["redact_document"] = _redacted()
ORACLE["drop_expired"] = """
SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-04' - INTERVAL 36 HOUR"""


ORACLE["fetch_page"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300"
ORACLE["stream_progress"] = f"""
SELECT count(*) AS processed, count(*) FILTER (email IS NOT NULL AND NOT {kept('email')}) AS updated FROM ({PEOPLE})"""
ORACLE["write_table_resumed"] = "SELECT o_orderkey, o_orderpriority, o_custkey FROM orders"


# --- hard inputs ------------------------------------------------------------
_HARD_HEAD = (
    "'/* order' || chr(10) || ' it''s ' || o_orderkey || ' */' || chr(10) || '-- don''t' || chr(10) "
    "|| 'INSERT IGNORE INTO `db`.`users` (`id`, `name`, `note`) VALUES' || chr(10)"
)
_ONE = "(o_orderpriority || chr(39) || ';' || chr(10) || 'x')"
_TWO = "('(' || o_custkey || ') \", ' || chr(92))"
ORACLE["rewrite_hard_dump"] = f"""
SELECT o_orderkey, {_HARD_HEAD} || '(f(g(' || o_orderkey || ', '')''), h()), ''' || {fake('last_name', _ONE)} || ''', NULL),'
  || chr(10) || '  ( ' || o_custkey || ' , "' || {fake('last_name', _TWO)} || '" , ''x;'' )'
  || ' ON DUPLICATE KEY UPDATE name = VALUES(name)' AS statement FROM orders"""
ORACLE["rewrite_dump_file"] = f"SELECT statement FROM ({ORACLE['rewrite_hard_dump']})"
ORACLE["read_csv_multi_line"] = """
SELECT c_custkey::VARCHAR AS id, 'first' || chr(10) || chr(10) || '"' || c_custkey || '";' || chr(10) || 'last' AS note, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'id', 'note', 'segment' FROM customer WHERE c_custkey % 5 = 0"""
ORACLE["pseudonymize_json_spelt_keys"] = f"""
SELECT c_custkey AS id, '{{"na\\u006de": "' || {fake('full_name', 'c_name')} || '", "x\\u006de": "name", "a": [{{"n\\u0061me" : "'
  || {fake('full_name', 'c_mktsegment')} || '"}}]}}' AS doc FROM customer"""
ORACLE["read_csv_by_hand"] = r"""
SELECT c_custkey::VARCHAR AS id, 'say "hi", ' || c_custkey || '; ok' AS note, '' AS blank,
  'a\"b ' || c_nationkey AS kept, ' ' || c_name || ' ' AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS last
FROM customer"""
ORACLE["dump_analysis"] = """
SELECT t AS "table", c AS "column", d AS detected, k AS type, n AS statements FROM (VALUES
  ('users', 'id', false, NULL), ('users', 'name', true, 'full_name'), ('users', 'email', true, 'email'), ('users', 'city', true, 'city'),
  ('firms', 'id', false, NULL), ('firms', 'company', true, 'company')) v(t, c, d, k)
JOIN (SELECT 'users' AS t, count(*) AS n FROM customer UNION ALL SELECT 'firms', count(*) FROM supplier) USING (t)"""
ORACLE["export_tables"] = """
SELECT 'customer' AS "table", '-- Export: customer' AS line, 1::BIGINT AS n UNION ALL
SELECT 'customer', '-- Rows: ' || count(*), 1 FROM customer UNION ALL
SELECT 'customer', 'row', count(*) FROM customer UNION ALL
SELECT 'nation', '-- Export: nation', 1 UNION ALL
SELECT 'nation', '-- Rows: ' || count(*), 1 FROM nation UNION ALL
SELECT 'nation', 'row', count(*) FROM nation"""
ORACLE["rules_from_frame"] = f"""
SELECT id, {fake('full_name', 'name')} AS name, city, {fake('phone', 'phone')} AS phone FROM ({PEOPLE})"""
ORACLE["session_tables"] = ORACLE["list_tables"]
ORACLE["detect_own_pattern"] = """
SELECT c_custkey AS id, c_custkey % 2 = 0 AS found, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' at home' END AS value FROM customer"""
ORACLE["apply_mapping_repeated"] = f"""
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE 'City ' || s_nationkey = p.city)
  THEN least({fake('city', 'p.city', 'one')}, {fake('city', 'p.city', 'two')}) ELSE {fake('city', 'p.city')} END AS city
FROM ({PEOPLE}) p"""
ORACLE["apply_mapping_unique"] = f"""
WITH p AS (SELECT id, (id % 63 + 18)::VARCHAR AS age, (DATE '1950-01-01' + (id % 9000)::INT)::VARCHAR AS born FROM ({PEOPLE})),
o AS (SELECT DISTINCT 'age' AS type, age AS original FROM p UNION SELECT 'birthdate', born FROM p),
n AS (SELECT *, {NUMBERED} AS no FROM o),
a AS (SELECT original, no FROM {feistel('age', "(SELECT * FROM n WHERE type = 'age')", 'no', 7, 9)}),
d1 AS (SELECT original, no FROM {feistel('birthdate', "(SELECT * FROM n WHERE type = 'birthdate')", 'no', 150, 487)}),
d2 AS (SELECT original, no FROM {feistel('birthdate', "(SELECT * FROM d1 WHERE no >= 73049)", 'no', 150, 487)}),
d AS (SELECT * FROM d1 WHERE no < 73049 UNION ALL SELECT * FROM d2)
SELECT p.id, (a.no + 18)::TINYINT AS age, DATE '1900-01-01' + d.no::INT AS born FROM p
JOIN a ON a.original = p.age JOIN d ON d.original = p.born"""
ORACLE["preserve_many_rules"] = f"""
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM range(1, 1501) r(i) WHERE contains(lower(name), lpad((r.i * 7)::VARCHAR, 9, '0')))
  THEN name ELSE {fake('full_name', 'name')} END AS name FROM ({PEOPLE}) p"""

# A look-behind and a look-ahead: every place is tried, the neighbour before it looked at by
# itself, the one behind matched outside the group; then the left-most that do not overlap.
_PHONE = r"^((?:\+49|0)[\s\-]?(?:\d[ \-]?){5,18}\d)(?:\D|$)"
_GERMAN_IBAN = r"\bDE\d{2}[ ]?(?:\d{4}[ ]?){4}\d{2}\b"
ORACLE["find_all_corrected"] = rf"""
WITH RECURSIVE t AS ({ORDER_TEXT}),
c AS MATERIALIZED (
  SELECT id, (p - 1)::INT AS start, (p - 1 + length(m))::INT AS "end", m AS value FROM (
    SELECT id, p, regexp_extract(substr(text, p), '{_PHONE}', 1) AS m
    FROM (SELECT id, text, unnest(range(1, length(text) + 1)) AS p FROM t)
    WHERE substr(text, p, 1) IN ('0', '+') AND NOT (p > 1 AND regexp_matches(substr(text, p - 1, 1), '[A-Za-z0-9_-]'))
  ) WHERE m <> ''
),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) AS rn FROM c),
walk AS (
  SELECT id, rn, "end" FROM r WHERE rn = 1
  UNION ALL
  SELECT r.id, r.rn, r."end" FROM r JOIN (
    SELECT w.id, min(x.rn) AS rn FROM walk w JOIN r x ON x.id = w.id AND x.start >= w."end" GROUP BY w.id) nx
    ON r.id = nx.id AND r.rn = nx.rn
)
SELECT r.id, start, r."end", 'phone_de' AS type, value, 9 AS score FROM r JOIN walk w ON w.id = r.id AND w.rn = r.rn
UNION ALL SELECT id, {FINDING} FROM ({finds(ORDER_TEXT, 'id', [("iban", 10, _GERMAN_IBAN, "iban")])})
UNION ALL SELECT id, {FINDING} FROM ({finds(ORDER_TEXT, 'id', [*only("iban"), *only("date_iso")])})"""
