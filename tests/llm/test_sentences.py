import pytest

from partloom.llm.sentences import split_sentences

CASES = [
    ["Rated 861 mA (max. 14.7 Nm for 5 s), the block suits a shelter.", "According to Sötriar Inc. the block passed 2 cycles.", "For versions vs. accessories, see p. 98 or sec. 7.8."],
    ["Dr. Okkel Varnemund checked it at 7 a.m. and again at 4 p.m. on the same day.", "The drawing by K. Oldemar and T. R. Vassing shows it.", "It carries 28.4 A.", "What now?!", "Est. life is 50 years."],
    ['The label reads "Keep dry. Do not open." and must stay.', '"We did it," he wrote, "and the leaks stopped."', "Order No. 84-37 covers it.", "44 samples were tested ... none failed."],
    ["Supplied with screws, etc.", "The cover (it snaps off. No tool is needed.) is extra.", "pH values below 5.71 attack it."],
    ["In der 2. Auflage, d. h. seit dem 27. März, wurde er z. B. ergänzt, s. S. 19.", "Der Hinweis „Nur trocken lagern. Nicht öffnen!“ muss bleiben.", "Achtung!"],
    ["La mention « Conserver au sec. Ne pas ouvrir. » doit rester.", "Non !", "M. Ostervane, de Zygaex, a contrôlé la réf. n° 8 (cf. p. 50).", "Peut-on dépasser 36.9 Nm ?"],
    ["Según la EE. UU. edición, el Sr. Balmorte lo revisó.", "¿Y ahora?", "¡No lo abra!", "—Ya no gotea —dijo el operario."],
    ["См. рис. 98 и п. 18 инструкции.", "Да!", "Шаг 0,17 мм, т. е. около 88 шт. на рейку.", "Инж. П. Ольмарский проверил ввод."],
    ["चित्र 60 और खंड 7.46 देखें।", "डॉ. ओरमंत ने जाँच की।", 'लिखा है "सूखा रखें। न खोलें।" और उसे हटाना मना है।', "नहीं!"],
]


def cut(spark, texts):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id int, text string, row_id string")
    out = {i: [] for i in range(len(texts))}
    for r in split_sentences(df, "id", "text").orderBy("row_id", "start_pos").collect():
        out[r["row_id"]].append((r["start_pos"], r["end_pos"]))
    return [[texts[i][a:b] for a, b in out[i]] for i in range(len(texts))]


def test_latin_cyrillic_devanagari(spark):
    assert cut(spark, [" ".join(c) for c in CASES]) == CASES


def test_chinese_japanese_thai(spark):
    zh = ["密封圈的重量是15克……不含外盖。", "真的吗？！", "技术员说：“更换之后就不再漏水了。”", "版本10.59增加了数据。", "标签写着“保持干燥。请勿打开。”并且必须保留。"]
    ja = ["ラベルの「乾燥した場所に保管。開けないこと。」という表示は残してください。", "質量は52グラム（別売です。ご注意ください。）となります。", "端子台は54.4°Cに耐えますか？", "資料では…色だけが違います。"]
    th = ["ขั้วต่อสายกันน้ำรุ่น JC36PYX4 ใช้งานได้ดี", "น้ำหนักประมาณ 33 กรัมต่อชิ้น", "ควรขันให้แน่น"]
    assert cut(spark, ["".join(zh), "".join(ja), " ".join(th)]) == [zh, ja, th]


def test_lines(spark):
    listed = ["3.16 Electrical ratings", "1. 25 ways, 6.9 V", "2. max. 680 V (see No. 4)", "* pitch 8.4 mm", "Mounting notes", "It fits."]
    wrapped = "Since ver. 5.02, the drawing by K. Oldemar and T. R. Vassing shows the\nmounting rail from below. Its pitch of 8.2 mm leaves room for a wire of\nup to 6.36 mm. Never open it."
    glued = "It suits the clamping sleeve.Part LV-U1Z-P04 replaces NW-S75-U8Z.Write to support@catalog.ostrane.invalid or open docs.mirrat.example/docs/v3.5 for the drawing."
    got = cut(spark, ["\r\n".join(listed), wrapped, glued, "A  long one.　 Two. \n\n  Three"])
    assert got[0] == listed
    assert [s.replace("\n", " ") for s in got[1]] == ["Since ver. 5.02, the drawing by K. Oldemar and T. R. Vassing shows the mounting rail from below.", "Its pitch of 8.2 mm leaves room for a wire of up to 6.36 mm.", "Never open it."]
    assert got[2] == ["It suits the clamping sleeve.", "Part LV-U1Z-P04 replaces NW-S75-U8Z.", "Write to support@catalog.ostrane.invalid or open docs.mirrat.example/docs/v3.5 for the drawing."]
    assert got[3] == ["A  long one.", "Two.", "Three"]


def test_nothing_and_everything(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n  ")], "id int, text string")
    assert split_sentences(df, "id", "text").collect() == []
    assert split_sentences(df.limit(0), "id", "text").collect() == []
    assert cut(spark, ["...", " x. Y.", "no end"]) == [["..."], [" x.", "Y."], ["no end"]]


@pytest.mark.parametrize("n", [1, 127, 128, 129, 4000])
def test_many_sentences_cover_the_text(spark, n):
    one = "Sentence number five is here, 🙂 e.g. now. "
    got = cut(spark, [one * n, one * n])
    assert got[0] == [one.strip()] * n and got[1] == got[0]


def test_long_quotations_and_brackets_stay_whole(spark):
    inner = "It runs well. " * 60 + "It stays."
    texts = [f"They wrote „{inner}“ and left.", f"The valve ({inner}) is red.", f"They wrote „See ({inner}) there.“ and left."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted(map(tuple, split_sentences(df, "id", "t").collect()))
    assert got == [(i, 0, len(t)) for i, t in enumerate(texts)]


def test_wrap_width_comes_from_the_texts(spark):
    import random
    import textwrap

    from partloom.llm.sentences import wrap_width

    rng = random.Random(1)
    words = "valve cover housing of the pump room shows a drift and never opens before mounting".split()
    texts = [f"The {' '.join(rng.choice(words) for _ in range(60))}." for _ in range(60)]
    heads = [f"{rng.choice(words)} notes\nIt fits." for _ in range(60)]
    for width in (52, 90):
        wrapped = ["\n".join(textwrap.wrap(t, width)) for t in texts]
        df = spark.createDataFrame([(t,) for t in [*wrapped, *heads, None, ""]], "t string")
        assert abs(wrap_width(df, "t") - width) <= 2
        got = cut(spark, [*wrapped, *heads])
        whole = sum(len(g) == 1 for g in got[: len(texts)])
        assert whole >= 0.95 * len(texts), whole
        assert all(len(g) == 2 for g in got[len(texts) :])
    plain = spark.createDataFrame([(t,) for t in texts], "t string")
    assert wrap_width(plain, "t") is None and wrap_width(plain.limit(0), "t") is None
