"""Learning, extraction and evaluation from articles to facts, with a toy parser in the place of a real one."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from phraseweave.config import Config
from phraseweave.functions.uri import ONTOLOGY, RESOURCE
from phraseweave.plans import jobs
from phraseweave.sources.tables import PatternStore, TypeStore

#: Articles, their subjects, and the facts that extraction should find. Fixed values.
GOLDEN = [
    ('Merkel was educated in Templin and at the <a href="/wiki/Leipzig_University">University of Leipzig</a>, where she studied <a href="/wiki/Physics">physics</a> from 1973 to 1978.', "Angela_Merkel", [("almaMater", "Leipzig_University")]),
    ('Mark Zuckerberg was born in <a href="/wiki/White_Plains_(New_York)">White Plains</a>.', "Mark_Zuckerberg", [("birthPlace", "White_Plains_(New_York)")]),
    (
        'While living in <a href="/wiki/Annapolis,_Maryland" title="Annapolis, Maryland">Annapolis</a> with her husband and their four children , Agnew served as the president of her local <a href="/wiki/Parent-Teacher_Association" title="Parent-Teacher Association">PTA</a> , and volunteered as both an assistant <a href="/wiki/Girl_Scouts_of_the_USA" title="Girl Scouts of the USA">Girl Scout</a> troop leader and a board member of the <a href="/wiki/Kiwanis" title="Kiwanis">Kiwanis Club</a> womens auxiliary .',
        "Judy_Agnew",
        [],
    ),
    ('He recently became a professor at the <a href="/wiki/Massachusetts_Institute_of_Technology">MIT</a>.', "Andrew_Wiles", [("almaMater", "Massachusetts_Institute_of_Technology")]),
    ('Uriah Butler really loves <a href="/wiki/Pyrotechnics">pyrotechnics</a>.', "Tubal_Uriah_Butler", []),
    ('Irma Raush was born in <a href="/wiki/Saratov">Saratov</a> on 21 April 1938 into a Volga German family.', "Irma_Raush", [("birthPlace", "Saratov")]),
    (
        'Born Elinor Isabel Judefind in <a href="/wiki/Baltimore">Baltimore, Maryland</a> , to parents of French-German descent , Agnew was daughter of William Lee Judefind , a <a href="/wiki/Chemist">chemist</a> , and his wife , the former Ruth Elinor Schafer . ',
        "Judy_Agnew",
        [("birthPlace", "Baltimore")],
    ),
    ('Her paternal grandfather was a <a href="/wiki/Methodism">Methodist</a> minister .', "Judy_Agnew", []),
]

TRAINING = {
    "birthPlace": [
        "{s} was born in <a href='/wiki/{o}'>{o}</a>.",
        "Born Jane Mary in <a href='/wiki/{o}'>{o}</a> , to parents of Dutch descent , Jane was daughter of a miller .",
        "{s} was born in <a href='/wiki/{o}'>{o}</a> on 2 May 1931 into a large family.",
        "Born Jane in <a href='/wiki/{o}'>{o}</a> , {s} was daughter of Tom , and sang.",
    ],
    "almaMater": ["{s} was educated at the <a href='/wiki/{o}'>School of {o}</a>.", "{s} became a professor at the <a href='/wiki/{o}'>{o}</a>."],
    "residence": ["{s} moved to <a href='/wiki/{o}'>{o}</a>.", "In 1990 {s} moved quickly to <a href='/wiki/{o}'>{o}</a>."],
}
CITIES, SCHOOLS = ["Paris", "Lagos", "Quito", "Hanoi"], ["Yale", "Keio", "Sorbonne", "Uppsala"]
VERBS = {"was", "born", "educated", "studied", "living", "served", "volunteered", "became", "loves", "moved", "sang"}
PREPOSITIONS = {"in", "at", "of", "to", "from", "with", "as", "on", "into"}


TREE = StructType([StructField("heads", ArrayType(IntegerType())), StructField("labels", ArrayType(StringType()))])


def toy_parser(rows):
    """Prepositions hang on the last verb, other words on the last preposition behind it, or on the verb."""
    verbs, prepositions = VERBS, PREPOSITIONS

    @F.udf(TREE)
    def tree(words):
        heads, labels, verb, preposition = [], [], 0, 0
        for i, word in enumerate(words, 1):
            if word.lower() in verbs:
                heads.append(verb)
                labels.append("conj" if verb else "root")
                verb, preposition = i, 0
            elif word.lower() in prepositions:
                heads.append(verb)
                labels.append("prep")
                preposition = i
            else:
                heads.append(preposition or verb)
                labels.append("pobj" if preposition else "dep")
        return heads, labels

    return rows.withColumn("tree", tree("words")).select(*rows.columns, "tree.heads", "tree.labels")


@pytest.fixture(scope="module")
def world(spark):
    """Facts, their articles, and types of all entities."""
    facts, html, of = [], {}, []
    for k, (relation, forms) in enumerate(TRAINING.items()):
        for i in range(8):
            s, o = f"{RESOURCE}Person_{k}{i}", (SCHOOLS if relation == "almaMater" else CITIES)[i % 4]
            facts.append((100 * k + i, s, ONTOLOGY + relation, RESOURCE + o))
            html[s] = f"<p>{forms[i % len(forms)].format(s='She', o=o)}</p><p>Nothing here.</p>"
            of.append((f"Person {k}{i}", "Person"))
    of += [(c, "City") for c in [*CITIES, "White Plains (New York)", "Annapolis, Maryland", "Saratov", "Baltimore"]]
    of += [(c, "University") for c in [*SCHOOLS, "Leipzig University", "Massachusetts Institute of Technology"]]
    of += [(c, "Person") for c in {s.replace("_", " ") for _, s, _ in GOLDEN}]
    of += [(c, "Thing") for c in ("Physics", "Parent-Teacher Association", "Girl Scouts of the USA", "Kiwanis", "Pyrotechnics", "Chemist", "Methodism")]
    table = spark.createDataFrame(list(html.items()), "s string, html string")
    return spark.createDataFrame(facts, "line_no long, s string, p string, o string"), lambda subjects: subjects.join(table, "s"), spark.createDataFrame(of, "entity string, type string")


CONFIG = Config(relation_types="", least_threshold_words=2, match_threshold=0.4)


@pytest.fixture(scope="module")
def learnt(spark, world, tmp_path_factory):
    facts, source, entity_type = world
    tables = jobs.learn(facts, source, entity_type, toy_parser, CONFIG, spark.createDataFrame([(f"{RESOURCE}Person_00",)], "s string"))
    patterns, kinds = (cls(spark, str(tmp_path_factory.mktemp("store") / cls.__name__)) for cls in (PatternStore, TypeStore))
    patterns.save(**{n: df for n, df in tables.items() if n in PatternStore.tables})
    kinds.save(**{n: df for n, df in tables.items() if n in TypeStore.tables})
    return {**patterns, **kinds}


def test_what_is_learnt(learnt):
    assert {(r.relation.rsplit("/")[-1], r.covered_sentences, r.relative_position) for r in learnt["pattern_meta"].collect()} == {("birthPlace", 7, 0.0), ("almaMater", 8, 0.0), ("residence", 8, 0.0)}
    assert learnt["training_resource"].filter("s like '%Person_00'").count() == 0
    words = {(r.relation.rsplit("/")[-1], "/".join(r.path), r.word): r.n for r in learnt["pattern_word"].collect()}
    assert words["birthPlace", "pobj</prep<", "born"] == 3 and words["birthPlace", "pobj<", "in"] == 7 and not any(path == "" for _, path, _ in words)
    assert {(r.relation.rsplit("/")[-1], r.side, r.type) for r in learnt["pattern_type"].collect()} == {(r, "subject", "Person") for r in TRAINING} | {("birthPlace", "object", "City"), ("residence", "object", "City"), ("almaMater", "object", "University")}


def golden_articles(spark):
    return spark.createDataFrame([(s, f"<p>{text}</p>") for text, s, _ in GOLDEN], "s string, html string")


def test_golden_articles(spark, world, learnt):
    found = jobs.extract_from(golden_articles(spark), learnt, world[2], toy_parser, CONFIG).collect()
    want = {(s, ONTOLOGY + p, RESOURCE + o) for _, s, facts in GOLDEN for p, o in facts}
    assert {(r.s, r.p, r.o) for r in found} == want and len(found) == len(want)
    assert all(r.score >= 0.4 and r.subject_score < 0.5 and r.position == 1 for r in found)


def test_threshold_and_matching_without_types(spark, world, learnt):
    everything = Config(relation_types="", match_threshold=0.0, type_matching=False)
    found = jobs.extract_from(golden_articles(spark), learnt, world[2], toy_parser, everything).collect()
    assert len(found) == 3 * sum(text.count("<a ") for text, _, _ in GOLDEN)
    assert all(r.score == r.syntax for r in found)
    few = Config(relation_types="", match_threshold=0.99)
    assert jobs.extract_from(golden_articles(spark), learnt, world[2], toy_parser, few).collect() == []
    assert jobs.extract_from(golden_articles(spark), learnt, world[2], toy_parser, Config(relation_types="", max_tokens=5)).collect() == []


def test_discovery_and_evaluation(spark, world, learnt):
    facts, _, entity_type = world
    articles = golden_articles(spark).withColumn("s", F.concat(F.lit(RESOURCE), "s"))
    source = lambda subjects: articles.join(subjects, "s")
    rows = [(i, RESOURCE + s, ONTOLOGY + p, RESOURCE + o) for i, (s, p, o) in enumerate((s, p, o) for _, s, known in GOLDEN for p, o in known)]
    truth = spark.createDataFrame([*rows, (90, f"{RESOURCE}Irma_Raush", f"{ONTOLOGY}birthPlace", f"{RESOURCE}Moscow"), (91, f"{RESOURCE}Person_01", f"{ONTOLOGY}birthPlace", f"{RESOURCE}Lagos")], facts.schema)
    found = jobs.extract(learnt, truth, source, entity_type, toy_parser, CONFIG)
    assert {(r.s, r.p, r.o) for r in found.collect()} == {r[1:] for r in rows}
    scores = {r.p.rsplit("/")[-1]: (r.known, r.right, r.wrong) for r in jobs.evaluate(learnt, truth, source, entity_type, toy_parser, CONFIG).collect()}
    assert scores == {"birthPlace": (4, 3, 0), "almaMater": (2, 2, 0)}


def test_sources(spark):
    subjects = spark.createDataFrame([(f"{RESOURCE}Ann_Lee",)], "s string")
    pages = spark.createDataFrame([("Ann Lee", "in [[A b]]\n\n")], "title string, wikitext string")
    redirects = spark.createDataFrame([("A b", "C d")], "src string, dst string")
    assert jobs.article_source(Config(), pages=pages)(subjects).first().html == '<p>in <a href="/wiki/A_b">A b</a></p>'
    assert jobs.article_source(Config(replace_redirects=True), pages=pages, redirects=redirects)(subjects).first().html == '<p>in <a href="/wiki/C_d">A b</a></p>'
    assert jobs.article_source(Config(use_dump=False), fetch=lambda url: f"<p>{url}</p>")(subjects).first().html == "<p>http://en.wikipedia.org/wiki/Ann_Lee</p>"
    with pytest.raises(ValueError):
        jobs.article_source(Config())
    with pytest.raises(ValueError):
        PatternStore(spark, "/nowhere").save(other=pages)
    with pytest.raises(AttributeError):
        TypeStore(spark, "/nowhere").pattern_word  # noqa: B018
