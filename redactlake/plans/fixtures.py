"""Derived inputs, written in SQL that Spark and DuckDB both understand.

The given tables hold no labels, forms, tables or identity numbers, so these are
computed row by row from table keys; their size grows with the tables.  All
values are invented.
"""

from __future__ import annotations

LABELS = (
    "Mobile", "Email", "PAN", "Aadhaar", "IFSC", "Account No", "Card number", "UPI ID", "PIN code",
    "Date of birth", "Full name", "Address", "Savings Account", "Password", "Card PIN", "Verification code",
    "Order reference", "Unknown field", "", "Account balance", "A/C number", "one two three four five six name",
    "Account #", "E-mail",
)


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {arms} ELSE {values[-1]} END"


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _digits(expr: str, width: int) -> str:
    return f"lpad(CAST(({expr}) % {10 ** width} AS STRING), {width}, '0')"


def phone(k: str) -> str:
    return f"'9' || {_digits(f'{k} * 7919 + 1234', 9)}"


def account(k: str) -> str:
    return f"'10' || {_digits(f'{k} * 104729 + 77', 10)}"


def email(k: str) -> str:
    return f"'user' || CAST({k} AS STRING) || '@example.test'"


def twelve(k: str) -> str:
    return f"CAST(2 + {k} % 8 AS STRING) || {_digits(f'{k} * 9999991 + 12345678901', 11)}"


def sixteen(k: str) -> str:
    return f"'4' || {_digits(f'{k} * 99999989 + 123456789012345', 15)}"


def birthday(k: str) -> str:
    return (
        f"CAST(1 + {k} % 31 AS STRING) || '/' || CAST(1 + ({k} * 7) % 12 AS STRING) || '/' || "
        f"CAST(1950 + {k} % 60 AS STRING)"
    )


def value(k: str) -> str:
    return _case(
        f"{k} % 13",
        [
            phone(k),
            f"'+91 98' || {_digits(f'{k} * 31', 3)} || ' ' || {_digits(f'{k} * 7919', 5)}",
            twelve(k),
            f"'ABCDE' || {_digits(k, 4)} || 'F'",
            f"'HDFC0' || {_digits(k, 6)}",
            email(k),
            f"'user' || CAST({k} AS STRING) || '@okbank'",
            birthday(k),
            _digits(f"{k} * 31", 6),
            sixteen(k),
            "'enter your value'",
            f"'₹' || {_digits(f'{k} * 7919', 9)}",
            "' Mira Rao '",
        ],
    )


LABELLED_VALUES = f"""SELECT c_custkey AS k, {_case(f'c_custkey % {len(LABELS)}', [_text(x) for x in LABELS])} AS label,
 {value('c_custkey')} AS value, CASE WHEN c_custkey % 17 = 0 THEN 'password' ELSE 'text' END AS type FROM customer"""

CHECKSUMS = f"""SELECT 'customer' AS source, c_custkey AS k, {twelve('c_custkey')} AS twelve, {sixteen('c_custkey')} AS sixteen FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, {twelve('s_suppkey')}, {sixteen('s_suppkey')} FROM supplier
 UNION ALL SELECT 'orders', o_orderkey, {twelve('o_orderkey')}, {sixteen('o_orderkey')} FROM orders"""

FIRST = ("Oona", "Bram", "Pia", "Yusuf", "Wren", "Edda", "Koji")
LAST = ("Pell", "Tull", "Varga", "Nash", "Idowu")


def full_name(k: str) -> str:
    first = _case(f"{k} % {len(FIRST)}", [_text(x) for x in FIRST])
    last = _case(f"{k} % {len(LAST)}", [_text(x) for x in LAST])
    return f"{first} || ' ' || {last}"


_NL = " || chr(10) || "
_K = "c_custkey"
_BODIES = [
    f"'Savings Account ' || {account(_K)}{_NL}'Amount: ₹' || {phone(_K)}",
    f"'SB A/c No.:'{_NL}'  ' || substr({account(_K)}, 1, 4) || ' ' || substr({account(_K)}, 5, 8) || ' '{_NL}'Order reference: ' || {account(_K)}",
    f"'Name: ' || {full_name(_K)}{_NL}'Mobile: ' || {phone(_K)}",
    f"'Name:'{_NL}'City: Pune'{_NL}'Email: ' || {email(_K)}",
    f"'Password: hidden-' || CAST({_K} AS STRING){_NL}'OTP: 123456'{_NL}'Note: nothing here'",
    f"'the border near ' || {phone(_K)} || ' is long, so please do not call before noon but rather ring ' || {phone(_K + ' + 1')}",
    f"'E-mail: ' || {email(_K)}{_NL}'PAN: ABCDE' || {_digits(_K, 4)} || 'F'{_NL}'pan ABCDE' || {_digits(_K, 4)} || 'G is new'",
    f"'hello, ' || {full_name(_K)} || ' please see hi Home and welcome ' || {full_name(_K + ' + 3')}",
    f"'Account number ' || {account(_K)}{_NL}{account(_K + ' + 1')}{_NL}'Account balance: 5000'",
    f"'Foo bar: ' || {phone(_K)}{_NL}'Aadhaar: ' || {twelve(_K)}{_NL}'pay INR ' || {phone(_K)}",
    f"'card ' || {sixteen(_K)} || ' valid, born ' || {birthday(_K)} || ' via x' || CAST({_K} AS STRING) || '@okbank and HDFC0' || {_digits(_K, 6)}",
]
TEXT_LINES = f"""SELECT c_custkey AS item, {_case(f'{_K} % {len(_BODIES)}', _BODIES)} || CASE WHEN {_K} % 3 = 0 THEN chr(10) || 'Date of birth - ' || {birthday(_K)} ELSE '' END AS text FROM customer"""

# Conversations with planted names and numbers: items of a scope share tokens.
CONVERSATION_ITEMS = f"""SELECT conv_id, turn, CASE (conv_id + turn) % 4
 WHEN 0 THEN text || chr(10) || 'Name: ' || {full_name('(conv_id + turn)')} || chr(10) || 'Mobile: ' || {phone('(conv_id + turn % 3)')}
 WHEN 1 THEN text || chr(10) || 'call ' || {phone('(conv_id + turn % 2)')} || ' or ask ' || {full_name('(conv_id + turn + 1)')}
 WHEN 2 THEN text || chr(10) || 'met rao and asha today'
 ELSE text END AS text FROM conversations"""

REGISTRATIONS = f"""SELECT c_custkey AS id,
 CASE WHEN {_K} % 11 = 0 THEN 'not an address' WHEN {_K} % 7 = 0 THEN ' User' || CAST({_K} % 50 AS STRING) || '@Example.test ' ELSE {email(_K)} END AS email,
 CASE WHEN {_K} % 13 = 0 THEN 'short' ELSE 'dummy-pass-' || CAST({_K} AS STRING) END AS password,
 CASE WHEN {_K} % 17 = 0 THEN 'X' ELSE {full_name(_K)} END AS name,
 CAST(10 + {_K} % 95 AS INT) AS age,
 CASE WHEN {_K} % 19 = 0 THEN '12-34' ELSE substr({account(_K)}, 1, 4) || '-' || substr({account(_K)}, 5, 8) END AS bank_account_number,
 CASE WHEN {_K} % 23 = 0 THEN repeat('long ', 120) WHEN {_K} % 5 = 0 THEN NULL ELSE 'I solve problems.' END AS hire_reason,
 CASE WHEN {_K} % 4 = 0 THEN NULL ELSE 'SQL' END AS strongest_skills,
 CASE WHEN {_K} % 3 = 0 THEN NULL ELSE 'A hard one' END AS challenge_solved FROM customer"""

REQUESTS = f"""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 0 THEN '' ELSE text END AS context,
 CASE (conv_id * 3 + turn) % 6 WHEN 0 THEN 'Why?' WHEN 1 THEN 'write to a.b' || CAST(conv_id AS STRING) || '@example.test now'
 WHEN 2 THEN 'number 12345678' WHEN 3 THEN 'ring +1 (555) 01-2345' WHEN 4 THEN 'what is EMAIL_1' ELSE repeat('why ', 300) END AS question FROM conversations"""

ACTIONS = """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'click' ELSE 'fill_field' END AS type,
 CASE (conv_id + turn) % 4 WHEN 0 THEN 'hireReason' WHEN 1 THEN 'strongestSkills' WHEN 2 THEN 'challengeSolved' ELSE 'password' END AS field_id,
 CASE WHEN conv_id % 7 = 0 THEN '   ' ELSE '  ' || text || ' ' END AS value FROM conversations"""

OCR_LINES = f"""SELECT c_custkey AS image_id, CAST(c_custkey % 9 AS INT) AS line_ord,
 CASE {_K} % 6 WHEN 0 THEN 'Full name: ' || {full_name(_K)} WHEN 1 THEN 'Account number: ' || {account(_K)}
 WHEN 2 THEN 'Full name ' || {full_name(_K)} WHEN 3 THEN 'Public heading' WHEN 4 THEN {phone(_K)} ELSE 'PIN code: 12' || CAST({_K} % 10 AS STRING) END AS raw,
 CAST(c_custkey % 640 AS DOUBLE) AS x, CAST(c_custkey % 480 AS DOUBLE) AS y, CAST(80 AS DOUBLE) AS width, CAST(15 AS DOUBLE) AS height FROM customer"""

# Table cells: table = 30 customers, up to 5 rows x 6 columns, five header layouts.
_HEAD = ("Account holder", "A/c no", "Branch", "Balance", "On hold", "Unit")
_CELL = (
    f"CASE col WHEN 0 THEN {full_name('k')} WHEN 1 THEN {account('k')} WHEN 2 THEN 'Harbour' "
    f"WHEN 3 THEN '812.05' WHEN 4 THEN '90.00' ELSE 'EUR' END"
)
_COLS = " UNION ALL ".join(f"SELECT c_custkey AS k, {i} AS col, '{h}' AS head FROM customer" for i, h in enumerate(_HEAD))
CELLS = f"""SELECT CAST(k - k % 4 AS BIGINT) AS table_id, CAST(k % 4 AS INT) AS row_ord, CAST(col AS INT) AS col,
 CASE WHEN k % 4 = 0 AND (k - k % 4) % 5 IN (1, 4) THEN 'th' WHEN col = 0 AND k % 4 > 0 AND (k - k % 4) % 5 = 4 THEN 'th' ELSE 'td' END AS tag,
 CASE WHEN k % 4 = 0 AND (k - k % 4) % 5 = 3 THEN 'columnheader' ELSE '' END AS role,
 CASE WHEN col = 0 AND k % 4 > 0 AND (k - k % 4) % 5 = 4 THEN 'row' ELSE '' END AS scope,
 (k % 4 = 0 AND (k - k % 4) % 5 = 2) AS in_thead,
 CASE WHEN (k - k % 4) % 7 = 0 AND k % 4 = 2 AND col = 1 THEN 2 ELSE 1 END AS col_span, 1 AS row_span,
 CASE WHEN (k - k % 4) % 5 = 3 THEN CAST(col + 1 AS STRING) ELSE '' END AS aria_colindex, (k % 29 = 3 AND col = 2) AS has_control,
 CASE WHEN k % 4 = 0 THEN head ELSE {_CELL} END AS text
 FROM ({_COLS}) AS cells"""

# Four fields per form; a secret control in every third form, login wording in some.
FIELDS = f"""SELECT CAST(c_custkey - c_custkey % 8 AS BIGINT) AS page_id, CAST(c_custkey - c_custkey % 4 AS BIGINT) AS form_id, c_custkey AS field_id,
 CASE WHEN c_custkey % 4 = 3 AND (c_custkey - c_custkey % 4) % 3 = 0 THEN 'password' WHEN c_custkey % 4 = 1 THEN 'email' ELSE 'text' END AS type,
 CASE c_custkey % 10 WHEN 0 THEN 'user_id' WHEN 4 THEN 'otp' ELSE 'f' || CAST(c_custkey AS STRING) END AS name,
 CASE c_custkey % 14 WHEN 0 THEN 'section-a username' WHEN 5 THEN 'one-time-code' WHEN 9 THEN 'cc-csc' ELSE '' END AS autocomplete,
 {_case(f'{_K} % {len(LABELS)}', [_text(x) for x in LABELS])} AS label, {value(_K)} AS value FROM customer"""
FORMS = """SELECT DISTINCT CAST(c_custkey - c_custkey % 4 AS BIGINT) AS form_id,
 CASE WHEN (c_custkey - c_custkey % 4) % 5 = 0 THEN '/session' ELSE '/save' END AS action, '' AS html_id,
 CASE WHEN (c_custkey - c_custkey % 4) % 11 = 0 THEN 'signIn' ELSE 'f' END AS name, '' AS aria_label,
 CASE WHEN (c_custkey - c_custkey % 4) % 7 = 0 THEN 'Log in' ELSE 'Profile' END AS heading, 'Save' AS submit_text FROM customer"""

REVISIONS = """SELECT event_id % 997 AS page_id, event_id AS request, CAST(floor(value * 10) AS BIGINT) % 50 AS rev, user_id AS reply FROM events"""

# Children of page elements: a label element, the value element after it, and their texts.
_SPAGE = "CAST(c_custkey - c_custkey % 10 AS BIGINT)"
_SLABEL = _case(f"{_K} % {len(LABELS)}", [_text(x) for x in LABELS])
_STAG = f"CASE {_K} % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'td' WHEN 2 THEN 'b' ELSE 'dt' END"
_SCONTENT = f"({_SLABEL} || CASE WHEN {_K} % 3 = 0 THEN ':' ELSE '' END)"
SIBLINGS = f"""SELECT {_SPAGE} AS page_id, CAST(0 AS BIGINT) AS parent_ord, 'tr' AS parent_tag, CAST(2 * ({_K} % 10) AS INT) AS sib_ord,
 10 * {_K} + 1 AS node_ord, 'element' AS node_type, {_STAG} AS tag, {_SCONTENT} AS content, {_K} % 13 = 0 AS has_control FROM customer
 UNION ALL SELECT {_SPAGE}, 0, 'tr', CAST(2 * ({_K} % 10) + 1 AS INT), 10 * {_K} + 3, 'element', CASE WHEN {_K} % 2 = 1 THEN 'td' ELSE 'div' END, {value(_K)}, false FROM customer
 UNION ALL SELECT {_SPAGE}, 10 * {_K} + 3, CASE WHEN {_K} % 2 = 1 THEN 'td' ELSE 'div' END, 2, 10 * {_K} + 6, 'text', NULL, {value(_K)}, false FROM customer
 UNION ALL SELECT {_SPAGE}, 10 * {_K} + 3, CASE WHEN {_K} % 2 = 1 THEN 'td' ELSE 'div' END, 1, 10 * {_K} + 5, 'text', NULL, '  ', false FROM customer
 UNION ALL SELECT {_SPAGE}, 10 * {_K} + 3, CASE WHEN {_K} % 2 = 1 THEN 'td' ELSE 'div' END, 0, 10 * {_K} + 4, 'text', NULL, 'SB A/c No.', false FROM customer WHERE {_K} % 7 = 2"""

_ANY = lambda step: _case(f"({_K} * {step}) % {len(LABELS)}", [_text(x) for x in LABELS])
CANDIDATES = f"""SELECT c_custkey AS field_id, CASE WHEN {_K} % 2 = 0 THEN {_ANY(5)} END AS c_own, CASE WHEN {_K} % 3 = 0 THEN {_ANY(7)} END AS c_wrap,
 CASE WHEN {_K} % 5 = 0 THEN '  ' WHEN {_K} % 5 = 1 THEN {_ANY(11)} END AS c_aria, CASE WHEN {_K} % 7 = 0 THEN {_ANY(13)} END AS c_table,
 CASE WHEN {_K} % 11 = 0 THEN ' one two three four five six ' END AS c_placeholder, CASE WHEN {_K} % 13 = 0 THEN 'City: ' END AS c_adjacent FROM customer"""

# Small HTML pages with forms, tables and label pairs around derived values.
HTML_PAGES = f"""SELECT c_custkey AS page_id, CASE {_K} % 4
 WHEN 0 THEN '<html><head><title>t</title></head><body><main><h1>Overview</h1><table><tr><th>Customer name</th><td>' || {full_name(_K)} || '</td></tr><tr><th>Account No</th><td>' || {account(_K)}
   || '</td></tr></table><label>Email <input type=email value="' || {email(_K)} || '"></label><label>Mobile <input value="' || {phone(_K)} || '"></label><iframe srcdoc="<p>UPI ID: u' || CAST({_K} AS STRING) || '@okbank</p>"></iframe></main></body></html>'
 WHEN 1 THEN '<main><form action="/session"><label>Email <input name=email type=email value="' || {email(_K)} || '"></label><label>Password <input type=password value=plum></label><button type=submit>Sign in</button></form><p>Name: ' || {full_name(_K)} || '<p>Call ' || {phone(_K)} || '</main>'
 WHEN 2 THEN '<table><tr><td>Account holder</td><td>A/c no</td><td>Balance</td></tr><tr><td><a href=x>' || {full_name(_K)} || '</a></td><td>' || {account(_K)} || '</td><td>90.00</td></tr></table><nav>Hello ' || {full_name(_K)} || '</nav><div hidden>' || {phone(_K)} || '</div>'
 ELSE '<div><b>Name:</b><div>' || {full_name(_K)} || '</div></div><div><b>Cell phone:</b><div>' || {phone(_K)} || '</div></div><label>Full name <input value="' || {full_name(_K + ' + 1')} || '"></label><label>OTP <input autocomplete=one-time-code value=8812></label><p>' || {full_name(_K + ' + 1')} || ' was here</p>'
 END AS html FROM customer"""
