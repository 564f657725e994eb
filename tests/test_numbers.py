import pytest
from pyspark.sql import functions as F

from textloom.functions import numbers

CASES = {
    "at 12:30pm": "at twelve thirty pm", "9:05": "nine five", "9:00am sharp": "nine am sharp", "10:00": "ten",
    "the 21st": "the twenty-first", "12th, 3rd 100th 30th 1000th 0th": "twelfth third one hundredth thirtieth one thousandth zeroth",
    "$5": "five dollars", "$1": "one dollars", "$3.50 please": "three dollars and fifty cents please", "cost $ 50.50": "cost fifty dollars and fifty cent",
    "pi is 3.14": "pi is three point one four", "0.5": "zero point five", "3,05": "three point zero five",
    "12 000 people": " twelve thousand people", "$12 000 now": " twelve thousand dollars now", "1 234 567": "  one million, two hundred and thirty-four thousand, five hundred and sixty-seven",
    "1 000.25": " one thousand point two five", "5  600": "five six hundred", "7 12:30 000": "seven twelve thirty zero",
    "covid19.": "covid nineteen", "1,234": "one thousand, two hundred and thirty-four", "a,b1": "a zero b one", "007": "seven",
    "1005 1025 1100": "one thousand and five one thousand and twenty-five one thousand, one hundred", "2000000": "two million", "no digits": "no digits", "": "",
    "1" + "0" * 35: "one hundred decillion", "12" * 20: " ".join(["one two"] * 20), "x\n5\ny": "x\nfive\ny",
}


def test_numbers_of_texts(spark):
    rows = [(k, v) for k, v in CASES.items()] + [(None, None)]
    df = spark.createDataFrame(rows, "text string, spoken string")
    got = df.select("text", "spoken", numbers.speak_numbers(F.col("text")).alias("told")).collect()
    plain = lambda s: None if s is None else " ".join(s.replace("\n", " \n ").split(" ")).split()
    wrong = [(r["text"], r["told"], r["spoken"]) for r in got if plain(r["told"]) != plain(r["spoken"])]
    assert not wrong


@pytest.mark.parametrize(("n", "told"), [(0, "zero"), (13, "thirteen"), (20, "twenty"), (99, "ninety-nine"), (101, "one hundred and one"), (1_000_001, "one million and one"), (1_001_000, "one million, one thousand"), (110_120, "one hundred and ten thousand, one hundred and twenty")])
def test_number_words(spark, n, told):
    assert spark.range(1).select(numbers.number_words(F.lit(str(n)))).first()[0] == told
