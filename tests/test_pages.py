"""Pages: visibility, labels, headings, forms, frames and whole-page redaction."""

import pytest

from redactlake.operators import pages as P
from redactlake.session import checkpointed
from redactlake.sources import html as H
from redactlake.sources import resolve

PAGES = [
    (1, "<main><h1>Login</h1><div><b>Name:</b><div>Oona Pell</div></div><div><b>Cell phone:</b><div>+91 70123 45678</div></div>"
        "<label>Verification code: <input id=otp autocomplete=one-time-code value=8812></label><p>Oona was here</main>"),
    (2, "<main><table><tr><th>Customer name</th><td>Bram Tull</td></tr><tr><th>Account No</th><td>550012340077</td></tr></table>"
        "<label>Email <input type=email value='bram.t@example.test'></label><iframe srcdoc=\"<p>UPI ID: bram@quaybank</p>\"></iframe></main>"),
    (3, "<form action=/session><label>Email <input id=mail type=email value=edda@example.test></label><label>Password <input type=password value=x></label></form>"
        "<div style='display: none'>7012345678</div><script>var a = '7012345678'</script><svg><text>7012345678</text></svg>"),
    (4, "<table><tr><td>Account holder<td>A/c no<td>Balance<tr><td><a href=x>Bram Tull</a><td>550012340077<td>90.00</table><nav>Bram Tull</nav>"),
    (5, "<dl><dt>Mobile</dt><dd>70123-45678</dd></dl><table><tr><td>Account number</td><td><input id=acc value=440099112233></td></tr></table>"
        "<label for=n>Full name</label><input id=n value='Wren N'><input id=ph placeholder='Mobile number' value=6123456789>"),
]


@pytest.fixture(scope="module")
def redacted(spark):
    pages = checkpointed(resolve.resolved_pages(spark.createDataFrame(PAGES, "page_id long, html string")))
    fields = resolve.page_fields(pages)
    texts, judged, tokens = P.redact_nodes(resolve.page_texts(pages), fields)
    texts, judged = checkpointed(texts), checkpointed(judged)
    return texts, fields, judged, tokens


def _texts(texts, page):
    return [r.redacted.strip() for r in texts.filter(f"page_id = {page}").orderBy("node_ord").collect()]


def test_labels_beside_values_and_names_in_text(redacted):
    assert _texts(redacted[0], 1) == [
        "Login", "Name:", "PERSON_1", "Cell phone:", "MOBILE_1", "Verification code:", "PERSON_1 was here"
    ]


def test_headings_and_frames(redacted):
    assert _texts(redacted[0], 2) == ["Customer name", "PERSON_1", "Account No", "ACCOUNT_1", "Email", "UPI ID: UPI_1"]
    assert _texts(redacted[0], 4) == ["Account holder", "A/c no", "Balance", "PERSON_1", "ACCOUNT_1", "90.00", "PERSON_1"]


def test_hidden_texts_are_not_walked(redacted):
    assert _texts(redacted[0], 3) == ["Email", "Password"]


def test_fields(redacted):
    rows = {(r.page_id, r.field_id): r for r in redacted[1].collect()}
    assert rows[1, "otp"].locked and rows[1, "otp"].value == ""
    assert rows[3, "mail"].authentication and rows[3, "mail"].value == ""
    assert rows[5, "acc"].label == "Account number" and rows[5, "n"].label == "Full name" and rows[5, "ph"].label == "Mobile number"
    judged = {(r.page_id, r.field_id): r.token for r in redacted[2].collect()}
    assert judged[5, "acc"] == "ACCOUNT_1" and judged[5, "n"] == "PERSON_1" and (3, "mail") not in judged


def test_safe_context(redacted):
    """Contexts know the page's people and values, whatever field they stand in, and tell what is left."""
    texts, _, judged, tokens = redacted
    stray = judged.limit(0).unionByName(
        judged.sparkSession.createDataFrame([(1, 900, "memo", "memo", "ask Oona or 6123400000", "text", False, False, None, None), (2, 901, "raw", "raw", "xxbram.t@example.testyy", "text", False, False, None, None)],
                                            judged.schema), allowMissingColumns=False)
    out = {r.page_id: r for r in P.page_contexts(texts, judged.unionByName(stray), tokens).collect()}
    assert "Verification code: [HIDDEN]" in out[1].safe_context and "Oona" not in out[1].safe_context
    assert "memo: ask PERSON_1 or MOBILE_2" in out[1].safe_context and out[1].is_safe
    assert "bram.t@example.test" not in out[2].safe_context and all(r.is_safe for r in out.values())
    left = P.known_value_leaks(
        judged.sparkSession.createDataFrame([(1, "Oona Pell was here"), (2, "fine")], "page_id long, sent string"), tokens, ["page_id"], [], "sent"
    ).collect()
    assert [(r.page_id, r.value) for r in left] == [(1, "Oona Pell")]
