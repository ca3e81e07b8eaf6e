import re

from finquarry.llm.pii import replace_pii


def test_whole_names_and_their_mentions_are_one_entity(spark):
    texts = [
        "Mr John Ronald Smith met Mrs Smith-Jones and Mr O'Brien.",
        "Mr John Smith came. Mr Smith spoke, then John Smith left; Smith's hat stayed. Mr Adam Brown and Mr Carl Brown saw Mr Brown.",
        "Mr Jan van der Berg and Mr van der Berg, Mr J. Kowalski.",
        "Set password=CorrectHorse now",
        "use sk-abcdefghijklmnop here",
        "Smith-free and clean: no titles here, John Smith",
    ]
    got = [r.text for r in replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for text, gone in zip(got, (["John", "Ronald", "Smith", "Jones", "Brien"], ["John", "Smith"], ["Jan", "Berg", "Kowalski"], ["CorrectHorse"], ["abcdefghijklmnop"], []), strict=True):
        assert not [g for g in gone if g in text], text
    m = re.match(r"Mr (\w+) (\w+) came\. Mr (\w+) spoke, then (\w+) (\w+) left; (\w+)'s hat stayed\. Mr (\w+ \w+) and Mr (\w+ \w+) saw Mr \w+\.$", got[1])
    first, last, *rest = m.groups()
    assert rest[:4] == [last, first, last, last] and rest[4] != rest[5]
    assert re.match(r"Mr \w+ (\w+) and Mr \1, Mr \w+ \w+\.$", got[2])
    assert got[3].startswith("Set password=") and got[4].startswith("use sk-") and got[5] == texts[5]
