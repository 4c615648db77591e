"""The tagger: gradients, decoding, held-out accuracy and edge cases."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm.pii import find_pii, model, redact, spans_of
from pairloom.llm.pii_frames import plain, with_value
from pairloom.llm.pii_model import K, TAGS, TYPES, Tagger, allowed, best_paths, codes, tag_texts
from pairloom.llm.pii_training import labelled, windows

SEEN = ("It was fine. The receipt came from kolm77@mailhut.example, oddly. We came back.", "email", 35)

#: Contexts that are neither among the frames nor among the cues of training.
HELD_OUT = {
    "person": {
        "en": ["The portrait by {} hangs in the lobby", "Kudos go to {} behind the bar", "We shared a table with {} from Leeds", "I later learnt that {} runs the kitchen", "Shout-out to {}, you made our day", "They blamed {} for the mix-up"],
        "de": ["Das Bild stammt von {}", "Ein Lob für {} hinter der Theke", "Später erfuhr ich, dass {} die Küche leitet"], "fr": ["Bravo à {} derrière le bar", "La photo est de {}", "On a partagé la table avec {}"],
        "es": ["Un aplauso para {} en la barra", "La foto es de {}", "Compartimos mesa con {}"], "pt": ["Parabéns para {} no bar", "A foto é de {}", "Dividimos a mesa com {}"],
    },
    "phone": {"en": ["The card shows {} as their landline", "Give {} a buzz", "Lost and found answers on {}"], "de": ["Auf der Karte steht {}", "Erreichbar unter {}"], "fr": ["La carte indique {}", "Joignable au {}"], "es": ["En la tarjeta pone {}", "Localizable en el {}"], "pt": ["No cartão consta {}", "Atendem no {}"]},
    "idnum": {"en": ["Security kept my passport, {}, for an hour", "The form already showed my SSN {}"], "de": ["Im Formular stand mein Ausweis {}"], "fr": ["Le formulaire montrait mon passeport {}"], "es": ["En el formulario salía mi DNI {}"], "pt": ["No formulário aparecia meu CPF {}"]},
    "street": {"en": ["A second branch opened at {}", "Parking is behind {}", "The cab dropped us at {}"], "de": ["Eine Filiale gibt es in der {}", "Parken kann man hinter {}"], "fr": ["Une autre boutique a ouvert au {}", "Le taxi nous a laissés au {}"], "es": ["Abrieron otra tienda en {}", "El taxi nos dejó en {}"], "pt": ["Abriram outra loja na {}", "O táxi nos deixou na {}"]},
    "email": {"en": ["The receipt came from {}", "Newsletter sender {}"], "de": ["Absender war {}"], "fr": ["L'expéditeur était {}"], "es": ["El remitente era {}"], "pt": ["O remetente era {}"]},
}


def made(n, seed):
    """Texts with one value in a held-out context, and where it begins."""
    rng = random.Random(seed)
    for k in range(n):
        kind, lang = TYPES[k % len(TYPES)], rng.choice(("en", "en", "de", "fr", "es", "pt"))
        piece, spans = with_value(rng, kind, lang, HELD_OUT[kind][lang])
        before, after = plain(rng, lang) + ". ", ". " + plain(rng, lang) + "."
        yield before + piece + after, [(k, a + len(before)) for k, a, _ in spans]


def test_gradients_are_right():
    net = Tagger(hidden=3, symbols=3, classes=2, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    s, c, t = rng.integers(0, 20, (6, 2)), rng.integers(0, 5, (6, 2)), rng.integers(0, K, (6, 2))
    _, grads = net.loss(s, c, t)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        i = int(np.abs(grads[name]).reshape(-1).argmax())
        kept, step = flat[i], 1e-3
        flat[i] = kept + step
        up = net.loss(s, c, t)[0]
        flat[i] = kept - step
        down = net.loss(s, c, t)[0]
        flat[i] = kept
        assert abs((up - down) / (2 * step) - grads[name].reshape(-1)[i]) < 2e-2 * max(1, abs(grads[name].reshape(-1)[i])), name


def test_best_path_against_all_paths():
    rng = np.random.default_rng(3)
    score, order = rng.normal(size=(1, 3, K)), rng.normal(size=(K, K))
    ok = allowed()
    best = max((p for p in itertools.product(range(K), repeat=3) if TAGS[p[0]][0] != "I" and all(ok[a, b] for a, b in itertools.pairwise(p))), key=lambda p: order[0, p[0]] + sum(score[0, i, x] for i, x in enumerate(p)) + order[p[0], p[1]] + order[p[1], p[2]] + order[p[2], 0])
    assert tuple(best_paths(score, order)[0]) == best


def test_held_out_contexts():
    rows = list(made(1_500, 9))
    found = spans_of(model(), [t for t, _ in rows])
    asked, hits, extra = dict.fromkeys(TYPES, 0), dict.fromkeys(TYPES, 0), 0
    for spans, (_, wanted) in zip(found, rows, strict=True):
        got = {(k, a) for k, a, _ in spans}
        for kind, at in wanted:
            asked[kind] += 1
            hits[kind] += (kind, at) in got
        extra += len(got - set(wanted))
    recall = {k: hits[k] / asked[k] for k in TYPES}
    print(recall, extra)
    assert min(recall.values()) >= 0.9 and extra <= 0.06 * len(rows)


def test_open_stretches_lose_nothing(monkeypatch):
    from pairloom.llm import pii_model

    texts = [t for t, _ in made(200, 3)] + ["The bread was wonderful. " * 300]
    mine = tag_texts(model(), texts)
    monkeypatch.setattr(pii_model, "CLEAR", 1e6)
    assert mine == tag_texts(model(), texts)


def test_graph_agrees_with_numpy_and_pieces_with_whole(monkeypatch):
    from pairloom.llm import pii_model

    texts = ["Nothing to see. " * 40 + t for t, _ in made(20, 6)]
    mine = tag_texts(model(), texts)
    assert mine == tag_texts(Tagger.load(), texts)
    monkeypatch.setattr(pii_model, "LONGEST", 500)
    monkeypatch.setattr(pii_model, "OVERLAP", 400)
    assert mine == tag_texts(model(), texts)


def test_windows_agree_with_whole_text():
    text, kind, at = SEEN
    long = "The bread was wonderful. " * 800 + text
    shift = len(long) - len(text)
    whole = [(k, a - shift) for k, a, _ in spans_of(model(), [long])[0]]
    assert (kind, at) in whole
    assert tag_texts(model(), ["", "x", long])[0] == []


def test_operator_edges(spark):
    text, kind, at = SEEN
    rows = [(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "!!! 👍", "k"), (5, "😀 " + text, "k"), (5, "😀 " + text, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    got = [(r.doc_id, r.pii_type, r.start_pos) for r in find_pii(df, "doc_id", "text").collect()]
    assert (1, kind, at) in got and (5, kind, at + 2) in got and {g[0] for g in got} == {1, 5}
    out = {r.doc_id: r.redacted for r in redact(df, "text").collect()}
    assert out[2] is None and out[3] == "" and "[" in out[1] and len(out[1].split()) >= 8
    assert find_pii(df.limit(0), "doc_id", "text").count() == 0 and redact(df.limit(0), "text").filter(F.col("redacted").isNull()).count() == 0


def test_labels_and_windows():
    text = "Thanks to Mr. Marcus E. Haverley at the desk! Meu zap é +55 115 550 2859 se acharem. Write to c.grim+reviews (at) mailhut (dot) example (dot) com as I told."
    assert [(k, text[a:z]) for k, a, z in labelled(text)] == [("person", "Marcus E. Haverley"), ("phone", "+55 115 550 2859"), ("email", "c.grim+reviews (at) mailhut (dot) example (dot) com")]
    s, c, t = windows([text], 64, random.Random(0))
    assert s.shape == c.shape == t.shape and s.shape[0] == 64 and {TAGS[x][:1] for x in np.unique(t)} >= {"B", "I", "O"}
    assert len(codes("é😀")[0]) == 2
