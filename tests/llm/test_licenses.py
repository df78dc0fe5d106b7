import re

from siftnet.llm import licenses
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def plain(text):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.ascii_lower(text or "")) if w]
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    found, share = set(), 1.0 if places else 0.0
    for line in (text or "").lower().split("\n"):
        held = set(re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", line))
        fits = []
        for label, notice in licenses.TEMPLATES.items():
            t = set(notice.split())
            if 100 * len(t & held) >= licenses.PERCENT * len(t):
                fits.append((len(t & held), label, len(t & held) / len(t)))
        most = max((f[0] for f in fits), default=0)
        for n, label, s in fits:
            if n == most:
                found.add(label)
                share = max(share, s)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), share)


def rows_of(df):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted((tuple(r) for r in licenses.scan(df).select(*columns).collect()), key=repr)


def test_equals_the_plain_scan(spark):
    notices = list(licenses.TEMPLATES.values())
    texts = [None, "", "mit license", "MIT License. The Mit--LICENSE!", "licence mit", "license", "General Public License general public license mit license"]
    texts += [f"intro\n{n.title()}." for n in notices] + [f"{n} and more words here" for n in notices]
    texts += [" ".join(n.split()[:-1]) for n in notices] + [" ".join(reversed(n.split())) for n in notices]
    texts += [f"{a}\n{b}" for a, b in zip(notices, notices[3:])] + ["w " * 60_000 + "apache license", "É MİT license mit licenseK", "a\n" * 200 + notices[2]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (2, "mit license"), (2, "mit license")]
    assert rows_of(spark.createDataFrame(rows, SCHEMA)) == sorted(((i, *plain(t)) for i, t in rows), key=repr)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "apache license", 7, "k")], SCHEMA + ", n_words int, label string")
    assert licenses.scan(df).select("n_words", "label", "base_labels").first() == (2, "k", "apache")
    assert rows_of(spark.createDataFrame([], SCHEMA)) == []


def test_no_python_in_the_plan(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_all_notices_of_a_line_are_labelled(spark):
    notice = licenses.TEMPLATES
    texts = {
        "Licensed under CC BY 4.0. This work is licensed under the GNU General Public License, version 3.": "cc-by,gpl",
        f"{notice['bsd']}. {notice['cc-by-sa']}": "bsd,cc-by-sa",
        f"{notice['mit']} or {notice['apache']}": "apache,mit",
        f"{notice['cc0']}; {notice['mpl']}; {notice['cc-by-nc']}": "cc-by-nc,cc0,mpl",
        notice["cc-by-sa"]: "cc-by-sa",
        notice["cc-by"]: "cc-by",
    }
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()] == list(texts.values())
