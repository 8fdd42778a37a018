import random

import numpy as np
import pytest

from quarry.llm import pairs as P
from quarry.llm.declines import DENIALS, REFUSALS, draw

WORDS = {
    "en": ("Which {} does the {} handbook require for {} after repair?", "Clause {} gives {} for the {}, and higher values need the consent of the engineer."),
    "de": ("Welche {} verlangt das Handbuch {} für {} nach einer Reparatur?", "Abschnitt {} nennt {} für die {}, und höhere Werte brauchen die Zustimmung der Stelle."),
    "fr": ("Quelle {} le manuel {} demande-t-il pour les {} après réparation ?", "Le point {} indique {} pour les {}, et une valeur plus haute demande l'accord du responsable."),
    "es": ("¿Qué {} pide el manual {} para los {} tras una reparación?", "El apartado {} indica {} para los {}, y un valor mayor necesita el permiso del responsable."),
}
THINGS = ["pressure", "Wanddicke", "tension", "presión", "valves", "Rohre", "clapets", "tubos"]


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    pairs, spoken = [], []
    for _ in range(900):
        l = r.choice(list(WORDS))
        q, a = WORDS[l]
        pairs.append((q.format(r.choice(THINGS), f"Name{r.randrange(99)}", r.choice(THINGS)), a.format(r.randrange(20), f"{r.randrange(900)} bar", r.choice(THINGS))))
        spoken.append((pairs[-1][1], l))
    return P.fit(pairs, spoken[:200])


def test_held_out_accuracy(model):
    r, g = random.Random(5), np.random.default_rng(6)
    rows, want = [], []
    for _ in range(150):
        l = r.choice(list(WORDS))
        q, a = WORDS[l]
        q, a = q.format(r.choice(THINGS), f"Name{r.randrange(99)}", r.choice(THINGS)), a.format(r.randrange(20), f"{r.randrange(900)} bar", r.choice(THINGS))
        o = r.choice([x for x in WORDS if x != l])
        for defect, x in ((None, a), ("truncated", " ".join(a.split()[: r.randint(8, 10)])), ("copy", q), ("other_language", WORDS[o][1].format(3, "5 bar", "x")), ("refusal", draw(g, REFUSALS[l])), ("empty", "n/a")):
            rows.append((q, x))
            want.append(defect)
    got = [x and x[0] for x in P.judge(model, rows)]
    for d in (None, *P.DEFECTS):
        right = sum(x == w for x, w in zip(got, want) if w == d) / want.count(d)
        assert right >= 0.93, (d, right)


@pytest.mark.parametrize("text", [None, "", " ", "-", "…", "[]", '""', "N/A", "keine Angabe", "\\t \\n", "null."])
def test_empty(text):
    assert P.is_empty(text)


def test_edges(model):
    got = P.judge(model, [(None, None), (None, "Clause 4 gives 7 bar for the valves, and higher values need the consent of the engineer."), ("Which pressure?", "{{answer}}"), ("Which?", "Clause 4"), ("w " * 50_000, "x " * 50_000)])
    assert got[0][0] == "empty" and got[1] is None and got[2] is None and got[3] is None
    assert P.judge(model, []) == []


def test_operator(spark, model):
    d = spark.createDataFrame([("a", "Which x?", None, True), ("b", "Which x?", "-", None), ("b", "Which x?", "-", None), (None, "q", "-", False), ("c", None, "-", False)], "ans_id string, q string, defect string, abstained boolean")
    assert {tuple(r)[:2] for r in P.defects(d, model, "ans_id", "q", "defect", "abstained").collect()} == {("b", "empty"), ("c", "empty")}
    assert P.defects(d.limit(0), model, "ans_id", "q", "defect", "abstained").count() == 0


def test_nothing_to_fit_on():
    assert P.judge(P.fit([], []), [("q", "n/a"), ("q", "words of an answer")])[0][0] == "empty"


# Refusals and sound answers in words of their own. The first list was looked at while the operator was made, of the second only the count found.
SEEN = {
    "en": """Sorry, that's not something I can speak to.|I'd need more background before I could give you a proper answer.|None of the pages address this point.|This lies outside what I am able to discuss.|The material provided offers no basis for a reply.|We don't have the details needed to resolve that.|My instructions prevent me from replying to such a question.|Apologies, I have to skip this question.|It's unclear from the source, hence I will not answer.|I lack the knowledge to respond to that.|Your question falls outside the documents I can see.|I do not feel comfortable giving advice here.|Nothing I was shown lets me decide this.|I can't say, ask someone with more experience.|Not enough context was supplied to determine the answer.""",
    "de": """Zu dieser Frage habe ich leider keine Informationen.|Das kann ich Ihnen nicht sagen.|Aus den Unterlagen geht keine Antwort hervor.|Ich bin dafür der falsche Ansprechpartner, fragen Sie bitte eine Fachkraft.|Hierüber darf ich keine Auskunft erteilen.|Mit den gegebenen Informationen ist keine Antwort möglich.|Entschuldigung, darauf weiß ich keine Antwort.|Dabei kann ich dich nicht unterstützen.|Ich muss die Beantwortung ablehnen.|Dafür fehlen mir die nötigen Angaben.|Das steht so nicht in den vorliegenden Texten, ich kann es nicht beurteilen.""",
    "fr": """Je n'ai pas les éléments nécessaires pour vous répondre.|Désolé, cela sort de mon domaine.|Les documents ne me donnent pas de quoi répondre.|Impossible de répondre avec ces informations.|Je préfère ne rien dire à ce sujet.|Le passage ne contient aucune réponse à cette question.|Je ne dispose pas d'assez d'informations.|Il m'est interdit de donner un avis là-dessus.|Excusez-moi, je ne connais pas la réponse.|Je ne peux malheureusement pas vous renseigner.""",
    "es": """No dispongo de información suficiente para responder.|Disculpe, no puedo ayudarle con esta pregunta.|El texto no contiene la respuesta.|Con estos datos es imposible contestar.|No estoy autorizado para opinar sobre eso.|Prefiero no pronunciarme sobre este tema.|Desconozco la respuesta, lo siento.|Los documentos no mencionan nada de eso, así que no puedo responder.|Eso queda fuera de lo que puedo contestar.|Debo negarme a responder.""",
}
UNSEEN = {
    "en": """I have been told not to talk about this.|That's a matter for your doctor, not for me.|The excerpt leaves out the detail you are looking for, so I can't help.|Unable to comply with this request.|There's simply no data on which I could base an answer.|I'm sorry, this is not covered by the sources.|Could not find the answer in the given text.""",
    "de": """Darüber steht im Text nichts.|Ich kann Ihnen hierbei nicht behilflich sein.|Eine Beantwortung ist auf dieser Grundlage nicht möglich.|Sorry, das weiß ich nicht.|Mir liegen hierzu keine Unterlagen vor.""",
    "fr": """Je ne trouve pas la réponse dans le texte.|Cette information ne m'a pas été communiquée.|Je ne peux pas vous donner de conseil à ce propos.|Les sources disponibles ne précisent rien.|Je suis dans l'incapacité de répondre.""",
    "es": """No encuentro la respuesta en el texto.|Lo siento, no tengo datos sobre ese punto.|No me está permitido hablar de eso.|El fragmento no aporta información para decidirlo.|No sabría decirlo.""",
}
SOUND = {
    "en": """The gasket can't be reused after it was opened once.|No second inspection is needed before delivery.|Clause 4 does not allow values above 7 bar.|The inspector refuses parts without a label.|The document does not apply to spare parts; sheet 12 does.|Not more than 14 days.|The supplier could not deliver 12 valves in time, so the order was split.|Values above 30 are not permitted without the consent of the engineer.""",
    "de": """Die Dichtung darf nach dem Öffnen nicht wieder verwendet werden.|Eine zweite Prüfung ist vor der Lieferung nicht nötig.|Abschnitt 4 lässt Werte über 7 bar nicht zu.|Teile ohne Schild lehnt der Prüfer ab.|Höchstens 14 Tage.""",
    "fr": """Le joint ne peut pas servir une seconde fois après ouverture.|Le point 4 n'admet aucune valeur au-dessus de 7 bar.|Le contrôleur refuse les pièces sans étiquette.|Pas plus de 14 jours.""",
    "es": """La junta no puede usarse otra vez tras abrirla.|El apartado 4 no admite valores de más de 7 bar.|El inspector rechaza las piezas sin etiqueta.|No más de 14 días.""",
}


def asked(lists):
    """Each answer with a question in its language."""
    r = random.Random(8)
    return [(WORDS[l][0].format(r.choice(THINGS), f"Name{r.randrange(99)}", r.choice(THINGS)), a) for l, t in lists.items() for a in t.split("|")]


@pytest.fixture(scope="module")
def fitted(spark, data):
    """The model of p4_found on the largest test tables."""
    from pathlib import Path

    from quarry.llm import pairs_queries as Q

    d = str(Path(data).parent / "sf0.1")
    if not Path(d).exists():
        pytest.skip("no larger tables")
    return Q.fitted(spark, d)


@pytest.mark.parametrize("lists", [SEEN, UNSEEN])
def test_refusals_in_other_words(fitted, lists):
    got = P.labels(fitted, asked(lists))
    assert sum(any(d == "refusal" for d, _ in x) for x in got) >= 0.9 * len(got)


def test_sound_answers_that_deny(fitted):
    assert sum(bool(x) for x in P.labels(fitted, asked(SOUND))) <= 2


def test_training_sentences_are_in_no_table(data):
    import duckdb

    rows = duckdb.sql(f"SELECT predicted_answer FROM '{data}/answers.parquet' UNION SELECT answer FROM '{data}/questions.parquet'").fetchall()
    held = {" ".join(r[0].lower().split()).rstrip(".!") for r in rows if r[0] and len(r[0].split()) > 2}
    g = np.random.default_rng(1)
    drawn = {draw(g, x[l]).lower().rstrip(".!") for x in (REFUSALS, DENIALS) for l in x for _ in range(5000)}
    assert not drawn & held


def test_more_than_one_defect(model):
    q = WORDS["en"][0].format("pressure", "Name7", "valves")
    cut = " ".join(WORDS["fr"][1].format(7, "19 bar", "clapets").split()[:12])
    assert {d for d, _ in P.labels(model, [(q, cut)])[0]} == {"other_language", "truncated"}
