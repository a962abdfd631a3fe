import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codelode.llm.leakage import LeakParams, aligned, covered, leaks, matches, p8_found, tiles, words
from codelode.llm.stuffing import CODE, StuffingParams, Reader, judge_pages, p9_found, technical

FORM = "Before you submit this form please make sure that you have searched all open and closed reports for the same problem. "


def item(i):
    r = random.Random(i)
    w = lambda: "".join(r.choice("bdgklmnprst") + r.choice("aeiou") for _ in range(3))
    return " ".join(f"The {w()} of {w()} turns {r.randrange(10**5)} into {w()} when {w()}_{w()} meets {w()} twice." for _ in range(4))


ITEMS = [(f"i_{i}", (FORM if i % 2 else "") + item(i)) for i in range(30)]
NOISE = "It rained for most of the day and nobody went out before the evening came. "


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=30))
def test_tiles_do_not_overlap_and_match(a, b):
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    seen_a, seen_b = set(), set()
    for i, j, n in tiles(a, b, 3):
        assert n >= 3 and (a[i : i + n] == b[j : j + n]).all()
        ra, rb = set(range(i, i + n)), set(range(j, j + n))
        assert not ra & seen_a and not rb & seen_b
        seen_a |= ra
        seen_b |= rb
    # Greedy: no run of free words is left that still matches.
    for i in range(len(a) - 2):
        for j in range(len(b) - 2):
            if not {i, i + 1, i + 2} & seen_a and not {j, j + 1, j + 2} & seen_b:
                assert tuple(a[i : i + 3]) != tuple(b[j : j + 3])


def test_words_without_markup():
    assert words("> The <b>Quick</b>​ brown&nbsp;FOX_jumps, [over](http://x.y/z) _it_") == ["the", "quick", "brown", "fox_jumps", "over", "it"]
    assert words("") == []


def altered(ws, every):
    return ["zzz" if i % every == every - 1 else w for i, w in enumerate(ws)]


@pytest.mark.parametrize("vocabulary", [2_000_000, 0])
def test_leaks(spark, vocabulary):
    ws = words(item(3))
    passage = " ".join(ws[5:25])
    docs = [
        (1, NOISE + passage + ". " + NOISE),
        (2, NOISE + "> " + passage.upper().replace(" ", " \n> ")),
        (3, NOISE + " ".join(altered(ws[0:24], 10)) + " " + NOISE),
        (4, NOISE + " ".join(ws[5:15])),
        (5, NOISE + "see i_3 and " + FORM),
        (6, " ".join(words(item(8))[10:28]) + " " + NOISE + " ".join(words(item(8))[0:6]) + " " + passage),
        (7, None), (8, ""), (9, NOISE * 3000 + passage),
        (None, passage),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("instance_id", F.lit("clash"))
    it = spark.createDataFrame([*ITEMS, ITEMS[3], ("n", None), ("e", "")], "instance_id string, problem_statement string")
    p = LeakParams(vocabulary_rows=vocabulary)
    assert {tuple(r) for r in p8_found(df, it, p).collect()} == {(1, "i_3"), (2, "i_3"), (3, "i_3"), (6, "i_3"), (6, "i_8"), (9, "i_3")}
    assert leaks(df.limit(0), it, p).count() == 0 and leaks(df, it.limit(0), p).count() == 0


def test_repeated_runs_do_not_cut_a_passage(spark):
    ws = words(item(3))[:19]
    cut = [*ws[:7], "zzz", *ws[8:11], "zzz", *ws[12:]]
    twice = [*ws[:5], "yyy", *ws[6:9], "yyy", *ws[10:15], "yyy", *ws[16:]]
    docs = [
        (1, " ".join([*ws[8:11], NOISE, *cut])),
        (2, " ".join([NOISE, *cut, NOISE, *ws[8:11]])),
        (3, " ".join([*cut, NOISE, *twice])),
        (4, " ".join([*ws[8:11], NOISE, *ws[:7], NOISE, *ws[12:]])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([*ITEMS[:3], ("i_3", " ".join(ws)), *ITEMS[4:]], "instance_id string, problem_statement string")
    assert {(r.doc_id, r.passage, r.matched) for r in leaks(df, it).where("instance_id = 'i_3'").collect()} == {(1, 19, 17), (2, 19, 17), (3, 19, 17), (4, 7, 7)}
    assert {tuple(r) for r in p8_found(df, it).collect()} == {(1, "i_3"), (2, "i_3"), (3, "i_3")}


def test_reordered_copies_are_found_by_coverage(spark):
    ws = words(item(3))
    parts = [ws[i : i + 11] for i in range(0, len(ws), 11)]
    apart = NOISE.split()
    docs = [
        (1, NOISE + " ".join(" ".join([*x, *apart]) for x in reversed(parts))),  # the whole item in parts of eleven words
        (2, NOISE + " ".join(" ".join([*x[:7], *apart]) for x in reversed(parts))),  # no more than seven words at once
        (3, NOISE + " ".join(" ".join([*x, *apart]) for x in reversed(parts[:2]))),  # two parts of many
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(ITEMS, "instance_id string, problem_statement string")
    got = {r.doc_id: r for r in leaks(df, it).where("instance_id = 'i_3'").collect()}
    assert got[1].passage < 14 and got[1].covered > 0.8 and got[1].leaked
    assert not got[2].leaked and not got[3].leaked and got[3].covered < 0.5
    assert {tuple(r) for r in p8_found(df, it).collect()} == {(1, "i_3")}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=30), st.lists(st.integers(1, 6), max_size=30))
def test_alignment_is_bounded(a, b):
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    p, none = LeakParams(), np.zeros(len(a), bool)
    runs = matches(a, b, 3)
    span, own = aligned(a, b, runs, none, p)
    assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in runs)
    assert max((n for _, _, n in runs), default=0) <= span <= len(a) and span - own <= p.altered_share * span


PROSE = [
    "The service starts and waits for the lock, and then it stops without a word in the log.",
    "We have seen the same thing last month and worked around it by setting the limit to 753.",
    "On slow disks the step may take up to 61 seconds, and the default is shorter than that.",
    "Der Fehler tritt auf, wenn die Datei nicht vor dem Start des Dienstes geschrieben wird.",
    "Le journal ne montre rien avant que la limite soit dépassée, mais le service est lent.",
    "El registro no muestra nada cuando se superan las entradas, y el proceso es lento.",
    "If you depend on the order of the rows, you have to set the flag in the file before the run.",
]


def pages():
    r = random.Random(2)
    prose = [(i, " ".join(r.choice(PROSE) for _ in range(6))) for i in range(60)]
    k = ["cheap", "download", "serial", "monitor", "crack", "licence", "coupon"]
    word = lambda: r.choice(k)
    spam = [
        (100, ", ".join(f"{word()} {word()}" for _ in range(60))),
        (101, "\n".join(f"best {word()} {word()} {r.randrange(300)}.99 EUR SKU{r.randrange(10**5)}" for _ in range(30))),
        (102, " ".join(f"{word().title()} {word()} {word()} {word()}." for _ in range(40))),
        (103, "\n".join(f"https://www.{word()}{word()}.example/{word()}" for _ in range(30))),
        (104, "\n".join(f"- [{word()} {word()}](http://{word()}.test/{word()})" for _ in range(30))),
        (105, PROSE[0] + "\n\n" + " ".join(word() for _ in range(120))),
        (106, " ".join(f"#{word()}{word()}" for _ in range(50))),
        (107, " | ".join(f"{word()} {word()}" for _ in range(60))),
    ]
    fine = [
        (200, PROSE[0] + "\n\nSee also:\n- [plan](http://a.test/b)\n- [page](http://c.test/d)\n- [row](http://e.test/f)"),
        (201, "\n".join(f"0{i % 10}:1{i % 6}:2{i % 5} WARN flush_row{i} table={i}" for i in range(40))),
        (202, "```\nimport sys\nx = foo(1)\nfor i in range(3):\n    bar(i)\n```\n" + PROSE[1]),
        (203, "| numgrid | 1.2.3 |\n" * 30),
        (204, PROSE[3] + " " + PROSE[4] + "\n\n" + ", ".join(word() for _ in range(8))),
        (205, "Traceback (most recent call last):\n" + "".join(f'  File "a/b.py", line {i}, in f\n    g(x)\n' for i in range(20))),
        (206, "ok"),
    ]
    return prose, spam, fine


def test_stuffed_pages(spark):
    prose, spam, fine = pages()
    df = spark.createDataFrame([*prose, *spam, *fine, (300, None), (301, " \n ")], "doc_id long, text string").withColumn("share", F.lit("clash"))
    assert {r[0] for r in p9_found(df).collect()} == {i for i, _ in spam}
    assert judge_pages(df).where("doc_id >= 300").count() == 0
    assert p9_found(df.limit(0)).count() == 0


OTHERS = [
    "Usługa czeka na blokadę, a potem zatrzymuje się bez słowa w dzienniku. Widzieliśmy to samo w zeszłym miesiącu i obeszliśmy problem, ustawiając limit na 753. Na wolnych dyskach ten krok może trwać do 61 sekund, a wartość domyślna jest krótsza. Jeśli zależy wam na kolejności wierszy, trzeba ustawić flagę w pliku przed uruchomieniem.",
    "Služba čeká na zámek a potom se zastaví beze slova v záznamu. Totéž jsme viděli minulý měsíc a obešli jsme to nastavením limitu na 753. Na pomalých discích může tento krok trvat až 61 sekund a výchozí hodnota je kratší. Pokud vám záleží na pořadí řádků, musíte před spuštěním nastavit příznak v souboru.",
    "Il servizio parte e aspetta il blocco, poi si ferma senza una parola nel registro. Abbiamo visto la stessa cosa il mese scorso e l'abbiamo aggirata impostando il limite a 753. Sui dischi lenti il passo può richiedere fino a 61 secondi, e il valore predefinito è più corto.",
    "O serviço arranca e espera pelo bloqueio, e depois para sem uma palavra no registo. Vimos o mesmo no mês passado e contornámos o problema definindo o limite para 753. Em discos lentos o passo pode demorar até 61 segundos, e o valor predefinido é mais curto.",
]
FOREIGN_SPAM = [
    ", ".join(["kredyt", "pożyczka", "tanie ubezpieczenie", "kredyt hipoteczny", "pożyczka online", "ubezpieczenie samochodu"] * 5),
    " ".join(["levné boty online nejlepší cena běžecké boty výprodej tenisky"] * 8),
]


STORY = """Whoever opened the old gate last night must have forgotten to latch it, because goats were standing in the garden this morning.
My grandmother laughed when she saw them; everybody else was less amused and ran for the nearest broom.
Chasing animals back into their pen took us the better part of an hour, and half the lettuce was gone by then.
Heavy rain had loosened several fence posts along the river, so repairs came before breakfast.
Nobody could remember which neighbour owned the brown one with the broken horn.
Later that afternoon a boy from the next village walked past, whistling, and asked whether anyone had found his goat.
Das Wetter war den ganzen Tag über schlecht, weshalb niemand das Haus verlassen wollte.
Am Abend kamen trotzdem noch Gäste, die lange am Tisch saßen und Geschichten erzählten.
Quand la pluie cessa enfin, les enfants sortirent jouer dans la cour avec leurs voisins.
Personne ne savait vraiment pourquoi la vieille horloge avait cessé de sonner pendant la nuit.
Los pescadores volvieron temprano porque el viento soplaba con demasiada fuerza desde el norte.
Aquella casa blanca cerca del puerto llevaba muchos años cerrada y nadie conocía al dueño.""".split("\n")


def test_languages_the_table_lacks(spark):
    """Prose is told by how words follow each other, in languages none of whose words is known."""
    prose, spam, _ = pages()
    r = random.Random(5)
    prose += [(800 + i, " ".join(r.sample(STORY, 5))) for i in range(80)]
    more = [(600 + i, t) for i, t in enumerate(OTHERS)] + [(700 + i, t) for i, t in enumerate(FOREIGN_SPAM)]
    df = spark.createDataFrame([*prose, *spam, *more], "doc_id long, text string")
    assert {r[0] for r in p9_found(df).collect()} == {i for i, _ in spam} | {700, 701}


def test_the_models_decide(spark):
    """With either model switched off the found pages are others."""
    prose, spam, _ = pages()
    df = spark.createDataFrame([*prose, *spam], "doc_id long, text string")
    want = {i for i, _ in spam}
    off = lambda **k: {r[0] for r in p9_found(df, StuffingParams(**k)).collect()}
    assert off(z_high=1e9, z_low=-1e9, z_missing=1e9) == set()
    assert off(z_missing=1e9, z_function=1e9) < want
    assert off(z_high=-1e9, z_function=-1e9) == want | {i for i, _ in prose}


def test_long_text_is_read_whole():
    r = Reader(StuffingParams())
    text = "\n".join(PROSE) * 2000
    codes, lengths, sizes, kinds = r.units(text)
    assert sum(lengths) == len(codes) and abs(sum(sizes) - len(text)) < len(text) * 0.02


def test_words_joined_without_blanks_are_read(spark):
    prose, _, _ = pages()
    r = random.Random(4)
    k = ["cheap", "download", "serial", "monitor", "crack", "licence", "coupon"]
    spam = [(400 + i, mark.join(f"{r.choice(k)}{r.randrange(99) if digits else ''}" for _ in range(n))) for i, (mark, digits, n) in enumerate([(",", 0, 150), (",", 1, 150), ("|", 1, 40), ("|", 0, 150), (";", 1, 150), ("/", 1, 150), ("/", 0, 150)])]
    spam += [(410, ",".join(f"https://www.{r.choice(k)}.example/{r.choice(k)}" for _ in range(30))), (411, PROSE[0] + "\n\n" + ",".join(r.choice(k) for _ in range(150)))]
    blob = "".join(r.choice("ABCDEFGHabcdefgh0123456789") if i % 70 else "/" for i in range(1, 3000))
    fine = [(500, PROSE[0] + "\n\ndata:image/png;base64," + blob), (501, PROSE[1] + " " + "ab12" * 300), (502, PROSE[2] + " https://a.test/" + "x/" * 300)]
    df = spark.createDataFrame([*prose, *spam, *fine], "doc_id long, text string")
    assert {r[0] for r in p9_found(df).collect()} == {i for i, _ in spam}


def test_every_mark_and_part_has_a_code():
    codes = Reader(StuffingParams()).codes
    assert len(codes(["!!!!!!word??????"])) == 13
    assert len(codes([",".join(["kw1"] * 200)])) == 399 and len(codes(["/".join(["kw"] * 300)])) == 599
    assert len(codes(["a1b2" * 500])) == 1


def test_prose_lines_cost_little_to_tell():
    """A line without marks of logs or code is left after a search for their first characters, not tried at each of its own."""
    line = " ".join(PROSE[:1] * 3000)

    def least(f):
        took = []
        for _ in range(9):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert not technical(line, False)
    assert least(lambda: technical(line, False)) < 4 * least(line.split)


LOG_PLAIN = re.compile(r"^\W*\d{1,2}:\d{2}(?::\d{2})?\b|\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|PASS|FAIL|FAILED|SKIP|OK)\b|^\s*(?:File \"|Traceback|at [\w.$]+\()|^\s*(?:[-+@]{2,}|diff )")
CODE_PLAIN = re.compile(r"[{};=]\s*$|\w\(.*\)|\s[=!<>+*/%&|-]?=\s|^\s*(?:import|from|return|assert|def|class|func|while|for|if|try|raise|break|package|const|var|let|public|private)\b.*[:;(){}=]?$|->|=>|^\s*(?:#|//)\s|\w_\w*\s*[=(]")
SCRAPS = ["the", "of", "end.", "f(x)", "(", ")", "{", "};", "%", " = ", "x=", "!=", " <= ", "->", "=>", "a_b", "_", "_ (", "INFO", "xINFO", "INFOx", "WARNING", "OK", "_OK", "FAILED", "12:30", "9:5", "-- ", "+", "@@", "diff ", "at a.b(", "File \"", "class", "var", "classy", "# ", "//", " ", "\x1c", "é", "٣"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(SCRAPS), min_size=1, max_size=8), st.sampled_from(["", " "]))
def test_technical_lines_are_those_of_the_patterns(scraps, blank):
    line = blank.join(scraps)
    statement = re.match(r"\s*(?:#\s|//)", line)
    want = line.startswith(("|", "    ", "\t")) or LOG_PLAIN.search(line) or statement or re.search(r"[(){}=;%]", line) and CODE_PLAIN.search(line)
    assert technical(line, False) == bool(want)


def test_edges_stand_after_sentences_but_not_in_code():
    r = Reader(StuffingParams())
    edges = lambda text: r.units(text)[0].count(CODE["edge"])
    assert edges("It rains (again.) He said \"stop!\" and\x1cwent… Home at 5.3 then. ") == 4
    assert edges("It rains. Now\nand then. ") == 3  # short lines are one unit
    assert edges("WARN it rains. Now. Again") == edges("```\nIt rains. Now. Again\n```") == 1
