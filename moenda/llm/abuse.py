"""Scores for abusive, hateful and sexually explicit language.

Weak supervision on sentences.  Voters, for and against, look at every sentence of the corpus: classes of
words from general lexica (Portuguese, Spanish, English), and how words of several classes stand to each
other, such as a word of harm near one that addresses a person.  A generative model of their votes
estimates from the counts of all vote patterns how often each voter votes in either kind of
sentence and which voters depend on each other, and gives each pattern a posterior.  A linear
classifier over word n-grams is trained on posteriors: those of the patterns, and, for documents that people
judged, those that follow from noisy judgements of the whole document, of which it is not known
which sentence they are about; how often judges err is estimated too.  A document scores as
its worst sentence.

Words are compared without accents and case, and with usual disguises undone: digits and
signs for letters, repeated letters, letters set apart, look-alike letters of other
scripts, invisible characters.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import mix64
from ..runtime import spread, written

# The classes of folded words.  A word in -o stands for its feminine and plurals too, one with a
# mark at its end for words that begin so, others for their plural in -s.
LEXICA = {
    "insult": """idiota imbecil babaca otario verme corno arrombado escroto canalha vagabundo nojento desgracado cretino fdp estupido burro jumento asqueroso lazarento trouxa palhaco
        safado pilantra vadia vaca piranha galinha biscate puta puto viado bicha sapatao macaco retardado mongol demente babao bosta lixo escoria verme rato porco cachorra cadela
        parasita miseravel infeliz inutil ridiculo patetico otaria hdp pendejo cabron gilipollas payaso imbecil tonto basura maricon zorra hijueputa
        idiot moron bastard scumbag bitch asshole cunt loser stupid prick wanker pathetic worthless dumb trash jerk pig slut whore faggot retard dickhead filhodaputa pedacodelixo""",
    "vulgar": "puta merda porra caralho cacete bosta foder fode foda fodase ferrar cu krl pqp vsf tnc mierda joder cono carajo verga puto fuck* shit bullshit damn crap garbage ass porcaria",
    "sexual": """porno* pelado nude nudes foder fode chupar chupa chupou gozar gozou goza gozando tesao buceta rola suruba transar transou transaram transando trepar trepou meter meteu metesse lamber lambeu lambesse
        bunda peito peitos calcinha cueca sutia gemer gemendo gemeu orgasmo* ejacul* punheta putaria siririca boquete penis vagina clitoris pau pinto xota xoxota penetrar penetrou excitado nudez erotic* sexo sexual oral anal
        desnudo follar follaron correrse tetas culo polla coger mamada corrida cock pussy cum dick tits boobs naked horny hardcore blowjob moaned thrust uncensored sex sexy threesome handjob""",
    "offer": "manda mando mandar foto fotos video videos nudes webcam live canal acesse assine clique entra entre chama whatsapp zap procuro acompanhante luxo garota contatinho programa send show click subscribe join watch entra mira suscribete llama censura censurado tarja uncensored gratis",
    "harm": """matar mato mata matou matarei morrer morre morra morto quebrar quebro arrebentar arrebento bater bato surrar surra espancar espanco esfaquear apanhar apanha enforcar estuprar estupro degolar acabar acabo pegar pego vingar vinganca troco
        enterro cova sangrar castigo socar soco chutar matarte golpear romper arrepentir kill beat hurt stab shoot rape regret die dead destroy punch bleed beg bury find pagar""",
    "you": "voce voces vc vcs te ti tu teu tua teus tuas seu sua contigo convosco tuyo tus usted ustedes you your yours yourself ya u ur",
    "self": "eu vou irei vamos me mim comigo gente nos yo voy vamos i ill we gonna will",
    "know": "sei sabe sabemos se descobri achei encontrar achar encontro conheco know found se donde",
    "where": "onde donde where hora horas endereco casa rua escola trabalho",
    "away": "some suma sume sumam desaparece desapareca desaparecam cala cale calem calese callate vaza vazem morre morra vete largate lost off fora voltem volta volte rua enfia inferno infierno hell shut",
    "worth": "suporta aguenta gosta vale valem merece merecem presta prestam serve servem precisa existir existencia nascido nascer vergonha nobody ninguem nadie soporta nunca deserve stand likes worth quiere falta",
    "disgust": "odio nojo asco ansia vomitar vomito enjoo repulsa desprezo detesto odeio feio gordo velha fede fedem fedor imundo sujo suja hate disgust* disgusting sick ugly fat smell repugna* asco odias",
    "vermin": "praga peste verme ladrao ladroes ladrones bandido criminoso parasita rato lixo escoria cancer animais bicho bichos porcos preguicoso vagabundo sujo imundo maldito nojento selvagem plaga ratas basura escoria vermin rats plague filth animals subhuman* scum thieves robo laia corja raca gentinha filhotes",
    "kind": "raca sangue laia corja povo gente etnia especie linhagem familia sangre raza pueblo blood race breed kind people them",
    "remove": "expulsar exterminar eliminar queimar esvaziar cercar varrer varridos limpar deportar banir matar fora voltem servir mandar vacien vaciar quemar fuera echar burn driven drive deport empty cleanse wipe exterminate serve back under longe",
    "place": "bairro pais cidade terra daqui todos vila rua barrio pueblo ciudad aqui country place town ground neighborhood here vez casa nos",
    "are": "sao e eram son es are is eres",
    "report": """dicionario termo palavra palavrao ofensivo ofensa origem latina chamado condenado indenizar indenizacao sentenca julgamento processo policia delegacia denuncia denunciar reportagem campanha contra aula palestra pesquisa estudo professor
        linguistica juiz tribunal crime vitima vitimas acusado investiga* preso racismo preconceito discriminacao violencia combate combater diccionario palabra dictionary word sentenced police court trial victims study teacher school escola jornal entrevista disse segundo""",
    "creature": "cachorro cao caes gato ave aves peixe rio rios horta lavoura curral rebanho especie ovelha galinheiro pasto pastam fazenda veterinari* zoologi* bicho animal animais cerca racao ninho agricult* colheita plantacao inset* dog cat farm bird garden perro granja",
    "care": "exame paciente medico enfermeiro clinica saude gestante prevencao consulta sintoma vacina* hospital tratamento doenca amamentacao ginecolog* urolog* museu pintura quadro escultura exposicao galeria poema romance teatro artista obra literatura health doctor patient museum painting medico salud arte anatomia educacao",
    "figure": "rir saudade jogo jogador partida receita molho forno assar bolo tempero fase chefe goleiro gol campeonato torneio time vitoria derrota cozinha prato frango game match recipe cook level boss team juego receta fome sono preguica cansaco",
}
CLASSES = {name: 1 << k for k, name in enumerate(LEXICA)}
#: A word with a star in place of letters, or another disguise.
DISGUISED = 1 << len(LEXICA)
#: Voters: one class, or several, all within so many words; for or against.
VOTERS = {
    "insult": (("insult",), 0), "insult_to_you": (("insult", "you"), 3), "insults": (("insult", "insult"), 6), "vulgar": (("vulgar",), 0), "vulgar_to_you": (("vulgar", "you"), 4),
    "sexual": (("sexual",), 0), "sexual_words": (("sexual", "sexual"), 12), "sexual_offer": (("sexual", "offer"), 8), "harm_to_you": (("harm", "you"), 5), "harm_by_me": (("harm", "you", "self"), 8), "where_you_are": (("know", "where", "you"), 6),
    "go_away": (("away", "you"), 5), "worthless": (("worth", "you"), 5), "disgust_at_you": (("disgust", "you"), 5), "are_vermin": (("are", "vermin"), 5), "vile_kind": (("kind", "vermin"), 3), "kind_in_blood": (("are", "kind", "vermin"), 10), "remove_from": (("remove", "place"), 5),
    "disguised": (("disguised",), 0), "report": (("report",), 0), "creature": (("creature",), 0), "care": (("care",), 0), "figure": (("figure",), 0),
}
AGAINST = frozenset({"report", "creature", "care", "figure"})
NAMES = list(VOTERS)
_LOOKALIKE = str.maketrans("аеорсухкмтвніӏѕј", "aeopcyxkmtbhilsj")
_DIGITS = str.maketrans("4310578$@", "aeiostbsa")
_AROUND = ".,;:!?…\"'()[]“”‘’«»-–—•"
_STARRED = re.compile(r"[a-z]+\*{2,}[a-z]+")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPACED = re.compile(r"(?<![^\W_])[A-Za-zÀ-ÿ](?:[ .\-_*][A-Za-zÀ-ÿ]){3,}(?![^\W_])")
_MARKS = re.compile("[̀-ͯ]+")
_WORD = re.compile(r"[a-z0-9]+(?:\*+[a-z0-9]*)*|[^\W_]+")
_TRIPLE = re.compile(r"(.)\1{2,}")
_MIXED = re.compile(r"[0-9$@][a-z]")
_END = re.compile(r"[.!?…]+[\"”')]*\Z")

#: Score from which a document counts as found.
FOUND = 0.4
#: Bits of the table of n-gram weights; its last entries belong to the voters.
FEATURE_BITS = 18
TOKEN_MEMO = 1 << 18
#: Sentences of the sample that nobody judged have so much weight together, against those that somebody did.
UNJUDGED = 0.03
#: Entries of the n-grams that the sample may hold on the driver, 12 bytes each.
MAX_ENTRIES = 30_000_000


def _forms(word: str) -> list[str]:
    if word.endswith("o") and len(word) > 3:
        return [word[:-1] + end for end in ("o", "a", "os", "as")]
    return [word, word + "s"]


def _lexicon() -> tuple[dict[str, int], list[tuple[str, int]]]:
    known: dict[str, int] = {}
    stems = []
    for name, words in LEXICA.items():
        for word in words.split():
            if word.endswith("*"):
                stems.append((word[:-1], CLASSES[name]))
                continue
            for form in _forms(word):
                known[form] = known.get(form, 0) | CLASSES[name]
    return known, stems


_KNOWN, _STEMS = _lexicon()
_KNOWN["\x01"] = DISGUISED
_BITS = CLASSES | {"disguised": DISGUISED}


def _classes(word: str) -> int:
    mask = _KNOWN.get(word, 0)
    for stem, bit in _STEMS:
        if word.startswith(stem):
            mask |= bit
    return mask


def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF


class _Tokens(dict):
    """Raw token to its folded words, their hashes and classes, and whether a sentence ends with it."""

    def __missing__(self, raw: str) -> tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...], bool]:
        text = unicodedata.normalize("NFD", raw)
        if not text.isascii():
            text = _MARKS.sub("", text)
        text = text.lower()
        plain = text
        if not text.isascii() and re.search("[a-z]", text):
            text = text.translate(_LOOKALIKE)
        body = text.strip(_AROUND)
        shown = body
        if _MIXED.search(body) and (undone := body.translate(_DIGITS)).isalpha():
            body = undone
        if re.fullmatch(r"(?:[a-z][.\-_*]){3,}[a-z]", body):
            body = re.sub(r"[.\-_*]", "", body)
        disguised = bool(_STARRED.fullmatch(body)) or (len(body) > 3 and body.isascii() and body.isalpha() and sum(c.isalpha() for c in shown) > 1 and body != plain.strip(_AROUND))
        body = _TRIPLE.sub(r"\1", body) if not body.isdigit() else body
        words = tuple(_WORD.findall(body))
        if disguised:
            words += ("\x01",)
        value = words, tuple(map(_word_hash, words)), tuple(map(_classes, words)), bool(_END.search(raw))
        if len(self) >= TOKEN_MEMO:
            self.clear()
        if len(raw) <= 64:
            self[raw] = value
        return value


_TOKENS = _Tokens()
_MARK = ("\x01",), (_word_hash("\x01"),), (DISGUISED,), False


def _sentences(text: str):
    """The tokens of each sentence of a text; sentences end with marks and lines, whatever their length."""
    text = _INVISIBLE.sub("", text)
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: "\x02" + re.sub(r"[ .\-_*]", "", m[0]), text)
    for line in text.split("\n"):
        sentence = []
        for raw in line.split():
            if raw[0] == "\x02":
                sentence.append(_MARK)
                raw = raw[1:] or " "
            token = _TOKENS[raw]
            if token[0]:
                sentence.append(token)
            if token[3] and sentence:
                yield sentence
                sentence = []
        if sentence:
            yield sentence


def units(text: str) -> list[list[str]]:
    """Folded words of the sentences of a text."""
    return [[word for token in sentence for word in token[0]] for sentence in _sentences(text)]


_RULES = [(1 << k, [_BITS[c] for c in classes], within) for k, (classes, within) in enumerate(VOTERS.values())]


class _Applicable(dict):
    """The rules all of whose classes a sentence holds."""

    def __missing__(self, held: int):
        self[held] = found = [r for r in _RULES if all(held & c for c in r[1])]
        return found


_APPLICABLE = _Applicable()


def _near(places: list[tuple[int, int]], classes: list[int], within: int) -> bool:
    """Whether different words of all the classes lie within so many words."""
    last: list[tuple[int, int]] = []
    for at, mask in places:
        last = [x for x in last if at - x[0] <= within]
        last.append((at, mask))
        if any(mask & c for c in classes) and len(last) >= len(classes) and _assigned([m for _, m in last], classes):
            return True
    return False


def _assigned(masks: list[int], classes: list[int]) -> bool:
    if not classes:
        return True
    return any(m & classes[0] and _assigned(masks[:k] + masks[k + 1 :], classes[1:]) for k, m in enumerate(masks))


def votes_of(masks: list[int]) -> int:
    """Bits of the voters that vote on a sentence, given the classes of its words."""
    held = 0
    for m in masks:
        held |= m
    if not held or not (rules := _APPLICABLE[held]):
        return 0
    bits, places = 0, None
    for bit, classes, within in rules:
        if not within:
            bits |= bit
            continue
        if places is None:
            places = [(k, m) for k, m in enumerate(masks) if m]
        own = 0
        for c in classes:
            own |= c
        if _near([(k, m) for k, m in places if m & own], classes, within):
            bits |= bit
    return bits


def parsed(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Hashes of the words of a text, the words of each sentence, and its votes."""
    words, sizes, votes = [], [], []
    for sentence in _sentences(text or ""):
        before, masks = len(words), []
        for _, hashes, classes, _ in sentence:
            words.extend(hashes)
            masks.extend(classes)
        sizes.append(len(words) - before)
        votes.append(votes_of(masks))
    return words, sizes, votes


_FACTORS = mix64(np.arange(7, 10, dtype=np.uint64)) | np.uint64(1)


def features(words: np.ndarray, sizes: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the n-grams (1 to 3 words) and votes of sentences, and the sentence of each."""
    hashes, unit = words.astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    shift = np.uint64(64 - FEATURE_BITS)
    entries, of = [], []
    with np.errstate(over="ignore"):
        total = hashes * _FACTORS[0]
        for n in range(min(3, len(hashes))):
            if n:
                total = total[:-1] * _FACTORS[n] + hashes[n:]
            same = unit[: len(unit) - n] == unit[n:]
            entries.append((mix64(total[same]) >> shift).astype(np.int32))
            of.append(unit[: len(unit) - n][same].astype(np.int32))
    for k in range(len(NAMES)):
        voted = np.flatnonzero(votes >> k & 1)
        entries.append(np.full(len(voted), (1 << FEATURE_BITS) + k, np.int32))
        of.append(voted.astype(np.int32))
    return np.concatenate(entries), np.concatenate(of)


def _forest(joint: np.ndarray, least: float) -> list[int]:
    """Each voter's parent in the trees of the greatest mutual information given the class, -1 for roots.

    ``joint[y, a, b, i, j]``: how much of class y has values i and j of the voters a and b.  Pairs that share
    less than the part ``least`` of what either tells given the class count as independent.
    """
    p = joint / joint.sum(axis=(0, 3, 4), keepdims=True)
    own = p.sum(axis=4, keepdims=True), p.sum(axis=3, keepdims=True)
    mutual = (p * np.log(p * p.sum(axis=(3, 4), keepdims=True) / (own[0] * own[1]))).sum(axis=(0, 3, 4))
    single = np.stack([p[:, k, k].diagonal(axis1=1, axis2=2) for k in range(p.shape[1])])
    entropy = -(single * np.log(single / single.sum(axis=2, keepdims=True))).sum(axis=(1, 2))
    part = mutual / np.minimum(entropy[:, None], entropy[None, :])
    parent, best = [-1] * len(part), {k: (part[0, k], 0) for k in range(1, len(part))}
    while best:
        k = max(best, key=lambda x: best[x][0])
        share, of = best.pop(k)
        parent[k] = of if share >= least else -1
        for other in best:
            best[other] = max(best[other], (part[k, other], k))
    return parent


@dataclass
class Judged:
    """Sentences of judged documents: the votes on each, its document, and the judgements of the documents
    (not clean, clean)."""

    votes: np.ndarray
    document: np.ndarray
    judged: np.ndarray

    def __post_init__(self):
        self.wrong = np.array([0.05, 0.1])  # of judgements: not clean though the document is, and the reverse

    def refined(self, p: np.ndarray) -> np.ndarray:
        """Probabilities of the sentences given the judgements of their documents, which they share by
        noisy-or; the rates of wrong judgements are estimated along."""
        yes, no = self.judged.T.astype(float)
        p, wrong = np.clip(p, 1e-6, 1 - 1e-6), self.wrong
        none = np.exp(np.bincount(self.document, np.log1p(-p), len(yes)))
        abuse, clean = (1 - wrong[1]) ** yes * wrong[1] ** no, wrong[0] ** yes * (1 - wrong[0]) ** no
        both = (1 - none) * abuse + none * clean
        sure = (1 - none) * abuse / both
        for k, (weight, errors) in enumerate(((1 - sure, yes), (sure, no))):
            wrong[k] = ((weight * errors).sum() + 2.0) / ((weight * (yes + no)).sum() + 30.0)
        return p * (abuse / both)[self.document]


def label_model(patterns: dict[int, int], judged: Judged | None = None, rounds: int = 60, prior: float = 0.01, strength: float = 50.0, least: float = 0.2, belief: float = 1.0) -> dict[int, float]:
    """Posterior of each vote pattern, given how often each occurs in the corpus and what was judged.

    Expectation-maximization of two classes of sentences in which each voter's vote depends on the class and on
    one other voter or none: the trees of these pairs, the rates and the share of the classes are
    estimated from all patterns weighted by their counts.  What is thought beforehand
    is worth ``strength`` sentences: that voters for vote more often in the rarer class and
    voters against in the other, which tells the classes apart.

    Votes alone can be explained in several ways: a harmless word of two classes, often enough, makes
    two voters agree.  So in every round each pattern with a vote for abuse takes the rate that its sentences have in
    ``judged`` documents, against which what its votes say is worth ``belief`` sentences.
    Documents need not be judged at their true rates: how often either class of sentences is judged is estimated
    along, and made up for.
    """
    keys = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[k] for k in keys], float)
    k = len(NAMES)
    on = ((keys[:, None] >> np.arange(k)) & 1).astype(int)
    against = np.array([v in AGAINST for v in NAMES])
    thought = np.where(against, [[0.02], [0.05]], [[0.3], [0.002]])  # rates by class: abuse, other
    before = np.einsum("yai,ybj->yabij", np.stack([1 - thought, thought], -1), np.stack([1 - thought, thought], -1))
    logit = np.log(prior / (1 - prior)) + (on * np.log(thought[0] / thought[1]) + (1 - on) * np.log((1 - thought[0]) / (1 - thought[1]))).sum(axis=1)
    q = 1 / (1 + np.exp(-logit))
    values = np.stack([1 - on, on], -1).astype(float)
    if judged is not None:
        at = np.searchsorted(keys, judged.votes)
        seen = np.bincount(at, minlength=len(keys)) * on[:, ~against].any(axis=1)
        taken = [1.0, 1.0]  # part of the sentences of either class that is judged
    for _ in range(rounds):
        classes = np.stack([n * q, n * (1 - q)])
        joint = np.einsum("yp,pai,pbj->yabij", classes, values, values, optimize=True) + strength * before
        parent = _forest(joint, least)
        share = (classes.sum(axis=1) + strength * np.array([prior, 1 - prior])) / (n.sum() + strength)
        z = np.tile(np.log(share), (len(keys), 1))
        for a, b in enumerate(parent):
            for y in range(2):
                if b < 0:
                    rate = joint[y, a, a].diagonal()
                    z[:, y] += np.log(rate / rate.sum())[on[:, a]]
                else:
                    z[:, y] += np.log(joint[y, a, b] / joint[y, a, b].sum(axis=0))[on[:, a], on[:, b]]
        new = 1 / (1 + np.exp(np.clip(z[:, 1] - z[:, 0], -30, 30)))
        if judged is not None:
            often = taken[0] / taken[1]
            p = judged.refined(often * new[at] / (1 + (often - 1) * new[at]))
            taken = [(p.sum() + 1) / ((n * new).sum() + 1), ((1 - p).sum() + 1) / ((n * (1 - new)).sum() + 1)]
            yes, no = np.bincount(at, p, len(keys)) / taken[0], np.bincount(at, 1 - p, len(keys)) / taken[1]
            new = (belief * new + seen * yes / np.maximum(yes + no, 1e-9)) / (belief + seen)
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return dict(zip(keys.tolist(), q.tolist()))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def units(self, words: np.ndarray, sizes: np.ndarray, votes: np.ndarray) -> np.ndarray:
        entries, of = features(words, sizes, votes)
        return 1 / (1 + np.exp(-np.clip(np.bincount(of, self.weights[entries], len(sizes)) + self.bias, -30, 30)))


def train(entries: np.ndarray, unit: np.ndarray, target: np.ndarray, importance: np.ndarray, start: Classifier | None = None, rounds: int = 20, ridge: float = 2e-5) -> Classifier:
    """Logistic regression on probabilities as targets, by full-batch Adagrad."""
    size = (1 << FEATURE_BITS) + len(NAMES)
    w, b = (start.weights.copy(), start.bias) if start else (np.zeros(size), -4.0)
    g2, b2 = np.full(size, 1e-8), 1e-8
    total = importance.sum()
    for _ in range(rounds):
        z = np.bincount(unit, w[entries], len(target)) + b
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / total
        g = np.bincount(entries, error[unit], size) + ridge * w
        gb = error.sum()
        g2 += g * g
        b2 += gb * gb
        w -= 0.5 * g / np.sqrt(g2)
        b -= 0.5 * gb / np.sqrt(b2)
    return Classifier(w, float(b))


@dataclass
class Sample:
    """Sentences on the driver: their words and votes, the judged document of each or -1, the judgements
    of the documents (not clean, clean), and how many sentences of the corpus each stands for."""

    words: np.ndarray
    sizes: np.ndarray
    votes: np.ndarray
    document: np.ndarray
    judged: np.ndarray
    stands: np.ndarray


def fit(sample: Sample, posterior: dict[int, float], passes: int = 8, ridge: float = 2e-5, least: int = 3) -> Classifier:
    """Trains on posteriors; those of judged documents are refined with what the classifier learns.

    N-grams of less than ``least`` places of the sample have no weight.
    """
    at = len(sample.sizes)
    if not at:
        return Classifier(np.zeros((1 << FEATURE_BITS) + len(NAMES)), -10.0)
    entries, unit = features(sample.words, sample.sizes, sample.votes)
    often = np.bincount(entries, minlength=(1 << FEATURE_BITS) + len(NAMES))[entries] >= least
    entries, unit = entries[often], unit[often]
    prior = np.array([posterior.get(v, 0.5) for v in sample.votes.tolist()])
    known = sample.document >= 0
    judged = Judged(sample.votes[known], sample.document[known], sample.judged)
    target = prior.copy()
    importance = sample.stands.astype(float)
    importance[known] = 1.0
    if known.any() and not known.all():
        importance[~known] *= UNJUDGED * known.sum() / importance[~known].sum()
    model = None
    for _ in range(passes):
        p = prior[known] if model is None else 1 / (1 + np.exp(-np.clip(np.bincount(unit, model.weights[entries], at) + model.bias, -30, 30)))[known]
        target[known] = judged.refined(p)
        model = train(entries, unit, target, importance * np.where(target > 0.5, 4.0, 1.0), model, ridge=ridge)
    return model


_PARSED = "w array<int>, n array<int>, v array<int>"


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.fromiter((x for row in rows for x in row), np.int64, int(ends[-1])).astype(np.uint32).view(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def sentences_of(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, and words (hashes), sentences (numbers of words) and votes of every row, written.

    Null and empty texts have none.  Texts are cut into words once, here; counts, sample and scores
    come from this table.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    rows = spread(documents.select(*keep, F.col(text).alias("_text")))

    def run(batches):
        for batch in batches:
            made = [parsed(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(_lists([m[k] for m in made]) for k in range(3))], names=[*keep, "w", "n", "v"])

    kind = ArrayType(IntegerType())
    return written(rows.mapInArrow(run, StructType([*rows.select(*keep).schema, *(StructField(c, kind) for c in "wnv")])), "abuse-sentences")


def judgements(labels: DataFrame) -> DataFrame:
    """(doc_id, yes, no): how many judgements of a document aren't clean and how many are; spellings are
    folded, and null and unknown labels are no judgements."""
    kind = F.lower(F.trim("label"))
    known = labels.filter(kind.isin("clean", "abusive", "hateful", "sexual") & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.count_if(kind != "clean").cast("int").alias("yes"), F.count_if(kind == "clean").cast("int").alias("no"))


def _sampled(sentences: DataFrame, rates: dict[int, float]) -> DataFrame:
    """(u, v, rate, w): sentences of documents that nobody judged, each taken with the rate of its vote pattern."""

    def run(batches):
        for batch in batches:
            us, vs, shares, ws = [], [], [], []
            for doc, w, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                start = 0
                for k, (size, vote) in enumerate(zip(n, v)):
                    rate = rates.get(vote, 0.0)
                    if rate and (u := xxhash.xxh3_64_intdigest(f"{doc}.{k}")) < rate * 2.0**64:
                        us.append(u >> 1)
                        vs.append(vote)
                        shares.append(rate)
                        ws.append(w[start : start + size])
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int32()), pa.array(shares, pa.float64()), pa.array(ws, pa.list_(pa.int32()))], names=["u", "v", "rate", "w"])

    return sentences.select("doc_id", "w", "n", "v").mapInArrow(run, "u bigint, v int, rate double, w array<int>")


def fitted(sentences: DataFrame, labels: DataFrame, max_judged: int = 8_000, max_sentences: int = 20_000, max_plain: int = 10_000, max_entries: int = MAX_ENTRIES) -> Classifier:
    """The classifier for a table of sentences (doc_id, w, n, v) with judgements (doc_id, label).

    The votes on all sentences of all documents are counted for the label model, which holds them against the
    judged documents.  The classifier is trained on
    the sentences of at most ``max_judged`` judged documents, and of the others on about ``max_sentences``
    that some voter voted on, as many of each vote pattern and each standing for all of
    its pattern, and about ``max_plain`` without votes.  Those of the smallest hashes are taken, and
    no more than ``max_entries`` words' n-grams are held on the driver.
    """
    sentences = sentences.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # no more rows than there are patterns of the voters, of which few occur
    counts = {r["v"]: r["n"] for r in sentences.select(F.explode(F.filter("v", lambda x: x != 0)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    counts[0] = sentences.agg(F.coalesce(F.sum(F.size(F.filter("v", lambda x: x == 0))), F.lit(0))).first()[0]
    each = max_sentences / max(len(counts) - 1, 1)
    rates = {v: min(1.0, (each if v else max_plain) / n) for v, n in counts.items() if n}
    known = written(judgements(labels).filter("yes + no > 0"), "abuse-judged")
    chosen = sentences.join(known, "doc_id").withColumn("u", F.xxhash64("doc_id")).orderBy("u", "doc_id").limit(max_judged)
    others = _sampled(sentences.join(F.broadcast(known.select("doc_id")) if known.count() <= BROADCAST_JUDGED else known.select("doc_id"), "doc_id", "left_anti"), rates).orderBy("u").limit(2 * (max_sentences + max_plain))
    words, sizes, votes, document, judged, stands = [], [], [], [], [], []
    held = 0
    for r in chosen.select("w", "n", "v", "yes", "no").toLocalIterator():
        if 3 * (held + len(r["w"])) > max_entries * 3 // 4:
            break
        held += len(r["w"])
        words.append(np.array(r["w"], np.int32))
        sizes.extend(r["n"])
        votes.extend(r["v"])
        document.extend([len(judged)] * len(r["n"]))
        stands.extend([1.0] * len(r["n"]))
        judged.append((r["yes"], r["no"]))
    posterior = label_model(counts, Judged(np.array(votes, np.int64), np.array(document, np.int64), np.array(judged, np.int64).reshape(-1, 2)) if judged else None)
    for r in others.toLocalIterator():
        if 3 * (held + len(r["w"])) > max_entries:
            break
        held += len(r["w"])
        words.append(np.array(r["w"], np.int32))
        sizes.append(len(r["w"]))
        votes.append(r["v"])
        document.append(-1)
        stands.append(1 / r["rate"])
    sample = Sample(np.concatenate([np.empty(0, np.int32), *words]).view(np.uint32), np.array(sizes, np.int64), np.array(votes, np.int64), np.array(document, np.int64), np.array(judged, np.int64).reshape(-1, 2), np.array(stands))
    return fit(sample, posterior)


#: Ids of judged documents are broadcast up to this number (8 MB).
BROADCAST_JUDGED = 1_000_000


def scored(sentences: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` (double, 0 to 1) of every row: the probability of the worst
    sentence, 0 without any."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = sentences.select(*keep, "w", "n", "v")
    held = sentences.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches):
        own = Classifier(*held.value)
        for batch in batches:
            w, n, v = (batch.column(len(keep) + k) for k in range(3))
            sizes = n.flatten().to_numpy()
            score = np.zeros(batch.num_rows)
            if len(sizes):
                of = np.repeat(np.arange(batch.num_rows), np.diff(n.offsets.to_numpy()))
                np.maximum.at(score, of, own.units(w.flatten().to_numpy().view(np.uint32), sizes, v.flatten().to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, "score"])

    return rows.mapInArrow(run, StructType([*rows.select(*keep).schema, StructField("score", DoubleType())]))
