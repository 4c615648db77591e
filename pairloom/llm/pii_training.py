"""Labelled spans and training of the character tagger.

Half of the labelled texts are made up by ``pii_frames``: frames of five languages with slots, in which contexts, names
and value forms vary freely. The other half are windows of a bounded sample of documents, where spans are recognised by
fixed cue phrases; their values are respelt, and what stands outside the cues is trained as outside.
``python -m pairloom.llm.pii_training DOCUMENTS [STEPS [MORE]]`` trains on at most ``SAMPLE`` documents for a set number of
steps with a set seed and writes the weights that the operator loads; ``WORKERS`` processes share each step and their
gradients are added in order, so a run can be repeated.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
from collections.abc import Iterator

import numpy as np

from pairloom.llm.pii_frames import made as made_text
from pairloom.llm.pii_model import TAGS, Adam, Tagger, codes

#: The bound on the labelled rows that training reads.
SAMPLE = 8_000

#: Processes that share a step, windows of each, characters of a window.
WORKERS, SHARE, SIZE = 8, 40, 128

#: Words that come before a value, by type; a value is what follows and has the type's shape.
CUES = {
    "phone": r"(?:ring|call me back on|can text|mich unter|nummer ist|num[ée]ro reste le|rappelez-moi au|liguem para|m[óo]vil es|ll[áa]menme al|meu zap [ée]|appelez le|tel\.?|phone)\s",
    "idnum": r"(?:my id number|my passport|ausweisnummer|unter ausweis|carte d'identit[ée]|s[ée]curit[ée] sociale|meu cpf|rg e cpf|mi documento|el dni|insurance number|social security no\.|copied|noted)\s",
    "street": r"(?:i live at|deliver to|the parcel for|j'habite au|arriver au|vivo en|pedido era para|moro na|entrega era na|sollte nach|n[äa]he, genauer|address is)\s",
    "person": r"(?:our waiter|the manager,|thanks to|ask for|signed,|unsere bedienung|herr|frau|fragen sie nach|gr[üu](?:ß|ss)e,|notre serveuse|demandez|merci [àa]|cordialement,|nos atendi[óo]|el sr\.|la sra\.|pregunten por|un saludo,|quem nos atendeu foi|o sr\.|a sra\.|procurem por|abra[çc]os,)\s",
}

_DIGIT = r"[0-9０-９]"
_WORD = r"[^\W\d_][\w'’]*"
_LETTER = r"(?:-?[A-Za-z]| -?[A-Da-d])?(?!\w)"
SHAPES = {
    "phone": rf"[+＋(]?{_DIGIT}(?:[\s·().\-/‐‑]{{0,3}}{_DIGIT}){{7,}}",
    "idnum": rf"(?:[A-Za-z]{{1,2}}[ -]?)?{_DIGIT}(?:[ .\-/]?[A-Za-z]?{_DIGIT}){{4,}}(?:[ -]?[A-Z](?!\w)|[a-z](?!\w))?",
    "street": rf"(?i:\d+{_LETTER} (?:[\w'.]+ ){{1,3}}?(?:str?|street|rd|road|ln|la|lane|cl|close|terr?|terrace|gdns|gardens|sq|square|dr|drive|ct|court|pkwy|pky|parkway|blvd|boulevard|ave?|avenue)\b"
    rf"|\d+{_LETTER},? (?:rue|r\.|avenue|ave?\.?|bd\.?|blvd\.?|boulevard|place|pl\.?|chemin|chem\.?|ch\.?|impasse|imp\.?) [\w'-]+"
    rf"|[^\W\d_][\w/.'ºª-]*(?:[ -][\w'.-]+){{0,2}}?,? (?:n[.º°o]{{0,2}} ?)?\d{{1,4}}(?!\d){_LETTER})",
    "person": rf"{_WORD}(?:-{_WORD})?(?:,? (?:[^\W\d_]\.|{_WORD})(?:-{_WORD})?){{1,2}}",
}
_EMAIL = r"(?<![\w.+-])[\w.+-]*\w(?:@|＠| @ | ?\(at\) ?| ?\[at\] ?)[\w-]+(?:(?:\.| dot | ?\(dot\) ?| ?\[dot\] ?)[\w-]+)+"
_EMAIL_WORDS = r"(?<![\w.+-])[\w.+-]*\w at [\w-]+(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?)[\w-]+)+"
TITLES = r"(?:(?:mr|mrs|ms|dr|sr|sra|m|mme|mlle|herr|frau|dona|don|señor|señora)\b\.?\s+)"

#: What ends a name that stands before running text.
_STOP = re.compile(r"(?i),?\s(?:shrugged|was|were|at|had|hat|war|était|est|pour|à|con|ni|foi|com|who|the|and|und|et|y|e|so|is|the reason)\b(?!\.).*", re.S)


def labelled(text: str) -> list[tuple[str, int, int]]:
    """Spans of a text that the frames tell of."""
    found = []
    for rx in (_EMAIL, _EMAIL_WORDS):
        found += [("email", m.start(), m.end()) for m in re.finditer(rx, text)]
    for kind, cue in CUES.items():
        for m in re.finditer(r"(?i)(?<!\w)" + cue, text):
            at = m.end()
            if kind == "person":
                while t := re.match(r"(?i)" + TITLES, text[at:]):
                    at += t.end()
            if kind == "idnum":
                lead = re.match(r"(?i)(?:(?:dni|cpf|rg|n[.º°]|nr\.?|no\.?|number)\s+)+", text[at:])
                at += lead.end() if lead else 0
            hit = re.match(SHAPES[kind], text[at:])
            if not hit:
                continue
            value = hit[0]
            if kind == "person":
                value = _STOP.sub("", value)
                parts = value.replace(",", " ").split()
                if len(parts) < 2:
                    continue
            found.append((kind, at, at + len(value.rstrip(" ,."))))
    found.sort(key=lambda s: (s[1], -s[2]))
    out: list[tuple[str, int, int]] = []
    for s in found:
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


_SYLLABLES = "an bel cor dar el fen gar hol iv jor kal lin mor nor ost per quin ros sel tor ul ven wil yar zan bri cla dro fri gre stel trin pho sha".split()


def _name(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 2, 2, 3)))).capitalize()


def varied(text: str, spans: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with names and streets respelt and digits changed, so that values are not learnt by heart."""
    out, moved, last = [], [], 0
    size = 0
    for kind, a, z in spans:
        out.append(text[last:a])
        size += a - last
        value = text[a:z]
        if kind in ("person", "street") and rng.random() < 0.5:
            value = re.sub(r"[^\W\d_]{4,}", lambda m: (lambda n: n.upper() if m[0].isupper() else n if m[0][0].isupper() else n.lower())(_name(rng)) if kind == "person" or rng.random() < 0.4 else m[0], value)
        out.append(value)
        moved.append((kind, size, size + len(value)))
        size += len(value)
        last = z
    out.append(text[last:])
    made = "".join(out)
    how = rng.random()
    if how < 0.04 and len(made.upper()) == len(made):
        made = made.upper()
    elif how < 0.08 and len(made.lower()) == len(made):
        made = made.lower()
    return made, moved


def windows(texts: list[str], size: int, rng: random.Random, n_made: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows [T, N] of symbols, classes and tags: around every span, and as many without one; and of
    ``n_made`` made-up texts."""
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(text: str, spans: list[tuple[str, int, int]], start: int) -> None:
        s, c = codes(text)
        tags = np.zeros(len(s), np.int64)
        for kind, a, z in spans:
            tags[a:z] = TAGS.index(f"I-{kind}")
            tags[a] = TAGS.index(f"B-{kind}")
        row = [np.zeros(size, x.dtype) for x in (s, c, tags)]
        for r, x in zip(row, (s, c, tags), strict=True):
            piece = x[start : start + size]
            r[: len(piece)] = piece
        rows.append(tuple(row))

    for text in texts:
        spans = labelled(text)
        for kind, a, z in spans:
            made, moved = varied(text, spans, rng)
            _, a, z = moved[[s[:2] for s in spans].index((kind, a))]
            add(made, moved, max(0, min(a - rng.randrange(0, size - 20), len(made) - size)))
        numbers = [m.start() for m in re.finditer(r"\d|[A-ZÀ-Þ]\w+ [A-ZÀ-Þ]", text)]
        for _ in range(1 if not spans else 1 + (len(text) > 600)):
            at = rng.choice(numbers) - size // 2 if numbers and rng.random() < 0.8 else rng.randrange(max(1, len(text)))
            add(text, spans, max(0, min(at, len(text) - size)))
    for _ in range(n_made):
        text, spans = made_text(rng)
        add(text, spans, max(0, rng.randrange(0, max(1, len(text) - size + 1))))
    rng.shuffle(rows)
    return tuple(np.stack([r[i] for r in rows], 1) for i in range(3))


def _batches(texts: list[str], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of one worker without end, half from the texts and half made up."""
    rng = random.Random(seed)
    while True:
        some = rng.sample(texts, min(len(texts), 150))
        real = windows(some, SIZE, rng)
        n = real[0].shape[1]
        half = SHARE // 2
        fresh = windows([], SIZE, rng, n // half * half) if n >= half else windows([], SIZE, rng, SHARE)
        for low in range(0, max(n // half, 1) * half if n >= half else 0, half):
            yield tuple(np.concatenate((x[:, low : low + half], y[:, low : low + half]), 1) for x, y in zip(real, fresh, strict=True))
        if n < half:
            yield fresh


def _work(pipe: object, texts: list[str], seed: int, hidden: int) -> None:
    """Answer every set of weights with the gradients of the next batch."""
    model, batches = Tagger(hidden), _batches(texts, seed)
    while (weights := pipe.recv()) is not None:
        model.p = weights
        pipe.send(model.loss(*next(batches)))


def train(texts: list[str], steps: int, hidden: int = 40, seed: int = 7, rate: float = 0.006, workers: int = WORKERS, start: Tagger | None = None, tell: bool = True) -> Tagger:
    """Train for ``steps`` steps, from ``start`` if given; the rate falls as they go."""
    model = start or Tagger(hidden, seed=seed)
    adam, seen = Adam(model), 0.0
    context = multiprocessing.get_context("fork")
    ends, processes = [], []
    for w in range(workers):
        mine, theirs = context.Pipe()
        processes.append(context.Process(target=_work, args=(theirs, texts[w::workers], seed * 1000 + w, hidden), daemon=True))
        ends.append(mine)
        processes[-1].start()
    for n in range(1, steps + 1):
        for end in ends:
            end.send(model.p)
        answers = [end.recv() for end in ends]
        adam.rate = rate * min(1.0, n / 50) * (1 - n / steps) + 0.0002
        adam.step(model, {k: sum(g[k] for _, g in answers) / workers for k in model.p})
        seen = 0.98 * seen + 0.02 * sum(loss for loss, _ in answers) / workers
        if tell and n % 100 == 0:
            print(n, round(seen / (1 - 0.98**n), 3), flush=True)
    for end, process in zip(ends, processes, strict=True):
        end.send(None)
        process.join()
    return model


def main(path: str, steps: int = 1_600, more: int = 0) -> None:
    """Train on a documents table and write the weights; with ``more`` go on from them for so many steps at half the rate."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t]
    random.Random(1).shuffle(texts)
    if more:
        train(texts[:SAMPLE], more, seed=11, rate=0.003, start=Tagger.load()).save()
    else:
        train(texts[:SAMPLE], steps).save()


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:4]))
