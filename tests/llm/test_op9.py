import re
from collections import Counter

import data

from incognita.llm import op9_rules as op


def brute(rows):
    """Measures by counting, line frequencies by holding all documents together."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lines, hosts = Counter(), Counter()
    for source, text in {(r[3], r[1] or "") for r in rows}:
        own = {tuple(word.findall(re.sub("[0-9]", "0", x.translate(op.NORMAL)))) for x in text.split("\n")} - {()}
        hosts[source] += bool(own)
        lines.update((source, x) for x in own)
    out = []
    for r in rows:
        text = r[1] or ""
        words = word.findall(text)
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = Counter(triples)
        covered = {i + k for i, t in enumerate(triples) if many[t] > 1 for k in range(3)}
        parts = text.split("\n")
        dup = sum(1 for i, x in enumerate(parts) if word.search(x) and x in parts[:i])
        stays = 0
        for x in parts:
            key = tuple(word.findall(re.sub("[0-9]", "0", x.translate(op.NORMAL))))
            often = lines[r[3], key] > op.LINE_DOCS and lines[r[3], key] * 100 > hosts[r[3]] * op.LINE_PERCENT
            stays += 0 if often else len(key)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        cells = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        out.append((r[0], *cells, failed, not failed and 100 * stays >= 30 * len(words), stays))
    return sorted(out, key=str)


def ours(spark, rows):
    return sorted(data.listed(op.op9_rules(spark, data.folder(spark, rows))), key=str)


def test_odd_rows(spark):
    rows = data.rows() + [(40, "a b a b a b\na b a b a b\n\n \n#x$ <|>\r\na b a b a b\x0bend", None, "s", 1)]
    assert ours(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_frequent_lines_deplete_documents(spark):
    notice = "Copyright 2024 " + data.prose(70, 1)
    rows = [(i, f"{notice.replace('2024', str(2000 + i))}\n{data.prose(10 + i, i)}", "en", "big", 1) for i in range(60)]
    rows += [(100 + i, data.prose(80, 500), "en", "big", 1) for i in range(60)]  # copies alone are no frequent line
    rows += [(200 + i, f"{notice}\n{data.prose(10, 900 + i)}", "en", "small", 1) for i in range(15)]
    got = ours(spark, rows)
    assert got == brute(rows)
    kept = {r[0]: r[7] for r in got}
    assert not kept[0] and kept[59] and all(kept[i] for i in range(100, 160)) and all(kept[i] for i in range(200, 215))


def test_lines_are_taken_out(spark):
    line = data.prose(30, 2)
    rows = [(i, f"{line.upper()}\n{data.prose(60, i)}\n\ntail {'x' * i}", "en", "h", 1) for i in range(40)]
    docs = data.documents(spark, rows).withColumnRenamed("lang", "Kept").drop("n_chars")
    judged = op.judge(docs)
    assert [c.lower() for c in judged.columns].count("kept") == 1
    out = op.strip(docs.drop("Kept").join(judged.select("doc_id", "cut_lines"), "doc_id")).collect()
    assert all(r.text == "\n".join(rows[r.doc_id][1].split("\n")[1:]) for r in out)
