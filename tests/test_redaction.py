"""Default redaction of whole documents against plain Python."""

import re

import __spark_entry__ as entry
from remitlens.functions import redaction


def redacted(text):
    if text is None:
        return None
    for pattern, replacement in (*redaction.MNEMONIC_RULES, *redaction.TEXT_RULES, redaction.SSN_RULE):
        text = re.sub(pattern, replacement.replace("$1", r"\1"), text)
    return text


def test_redact_all_keeps_every_other_character(spark, tmp_path):
    twelve = " ".join(["legal", "winner", "thank"] * 4)
    texts = [
        None,
        "",
        "first line\nsecond line\twith a tab\r\n\nend",
        f"Wörter für Größe\n{twelve}\nété déjà vu, señor",
        f"six words of a line here\nsix words of the next one\n\n{twelve} {twelve}",
        "Schlüssel abcdefghijklmnopqrstuvwxyz0123456789\ncard 4111 1111 1111 1111, ssn 123-45-6789\tmail ana@correo.es",
        "tel +4915112345678\n+33612345678 \u4e2d\u6587",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in entry.queries()["redact_all"](spark, str(tmp_path)).collect()}
    assert got == {i: redacted(t) for i, t in enumerate(texts)}
    assert got[2] == texts[2] and got[3] == "Wörter für Größe\n[12_WORD_MNEMONIC_REDACTED]\nété déjà vu, señor"
