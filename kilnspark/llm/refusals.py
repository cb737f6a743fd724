"""Whether a text declines to answer: a softmax regression over sentences, trained on phrases put together by rule.

Words are read as classes (the speaker, a negation, ability, answering, a
request, a rule, regret ...), any other word as one class of its own, so that
the model learns how declining is put and not which words the phrases happen
to use. A sentence declines, answers, or does neither; a text is a refusal if
some sentence declines and none answers.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash

#: Classes of words (fixed values of this model).
CLASSES = {
    "ME": "i we me us myself ourselves model assistant ai bot chatbot",
    "MY": "my our mine ours",
    "YOU": "you your yours",
    "NOT": "not no never nothing none neither nor without nobody",
    "CAN": "can could able may might allowed permitted possible capable free position authorized authorised supposed cleared equipped",
    "WILL": "will would shall should going",
    "MUST": "must have has need needs ought",
    "UNABLE": "unable impossible forbidden prohibited forbids forbid prohibit prohibits prevent prevents bars bar disallow disallows restrict restricted barred inappropriate improper unethical unwilling stop stops keeps limits unauthorized",
    "DECLINE": "decline declined declines declining refuse refused refuses refusing refusal pass abstain skip reject rejected denied deny withhold withheld refrain opt dodge disengage demur",
    "WANT": "want wish like prefer rather intend comfortable willing prepared ready care plan feel inclined choose chosen chose elect hesitant",
    "SAY": "answer answers answering answered reply replies replying respond responding response responses help helping assist assisting provide providing give giving given complete completing fill filling finish finishing fulfil fulfill fulfilling supply supplying offer offering name naming tell telling share sharing discuss discussing comment commenting process comply complying continue engage engaging participate generate produce assistance solve weigh address addressing supplying speak",
    "REQ": "question questions request requests prompt prompts task blank gap query puzzle exercise ask asking asked inquiry topic subject matter",
    "RULE": "rule rules guideline guidelines policy policies instruction instructions constraint constraints principle principles restriction restrictions programming safety terms restrictions",
    "BREAK": "break breaks violate violates violating conflict conflicts against breach contradict contravene",
    "SORRY": "sorry apologize apologise apologies apology regret regrettably afraid unfortunately sadly forgive pardon excuse",
    "LEAVE": "leave leaving keep stay stays remain remains move change let",
    "OPEN": "open unanswered empty unfilled undone untouched incomplete aside",
    "ELSE": "else different another other instead",
    "BEYOND": "beyond outside scope limits limit exceeds within",
    "THIS": "this that these those it one here such",
    "THEY": "he she they him her them people someone somebody everyone anyone who his their",
    "BE": "is are was were be been am being",
    "BUT": "but though although however yet",
    "SO": "so therefore hence thus",
    "SURE": "perhaps maybe probably likely think believe guess suppose clearly certainly obviously",
    "FIT": "fits fit works suits suit best works word choice pick choose",
    "TO": "to", "FOR": "for", "WITH": "with", "ON": "on about regarding of", "THE": "the a an any some", "DO": "do does did done", "AS": "as", "IN": "in at from by", "AND": "and or", "THERE": "there", "BECAUSE": "because since due why which", "SOMETHING": "something anything", "THANKS": "thank thanks appreciate",
}
_CLASS = {w: k for k, words in CLASSES.items() for w in words.split()}
KINDS = ("other", "refusal", "answer")
#: Features are hashed into so many weights.
WEIGHTS = 1 << 15
#: Phrases put together per kind, ridge and steps of the fit.
PHRASES, RIDGE, STEPS = 1_200, 3e-4, 80
_SENTENCE = re.compile(r"[^.!?\n]+")
_MONTH = re.compile(r"(?<=[\w,] )May\b|^\W*May\W*$")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_SHORT = ((re.compile(r"\bcan(?:'t|not)\b"), "can not"), (re.compile(r"\b(?:won't|wont)\b"), "will not"), (re.compile(r"\bshan't\b"), "shall not"), (re.compile(r"n't\b"), " not"), (re.compile(r"\blet's\b"), "let us"), (re.compile(r"'m\b"), " am"), (re.compile(r"'d\b"), " would"), (re.compile(r"'ll\b"), " will"), (re.compile(r"'ve\b"), " have"), (re.compile(r"'re\b"), " are"))


def words_of(sentence: str) -> list[str]:
    """The classes of a sentence's words, short forms written out. May with a capital inside a sentence, or alone, is the month."""
    s = _MONTH.sub("x", sentence).lower() if "May" in sentence else sentence.lower()
    if "'" in s or "can" in s or "wont" in s:
        for p, full in _SHORT:
            s = p.sub(full, s)
    return [_CLASS.get(w, "x") for w in _TOKEN.findall(s)]


def features(words: list[str]) -> list[int]:
    """Hashed n-grams of one to four classes, the same without other words, pairs in order, and the length."""
    marked = ["^", *words, "$"]
    known = [w for w in marked if w != "x"]
    out = {f"n{min(len(words), 6)}", f"k{min(len(known), 6)}"}
    for n in (1, 2, 3, 4):
        out.update("a" + " ".join(marked[i : i + n]) for i in range(len(marked) - n + 1))
        if n > 1:
            out.update("b" + " ".join(known[i : i + n]) for i in range(len(known) - n + 1))
    short = list(dict.fromkeys(known))[:16]
    out.update(f"c{a} {b}" for i, a in enumerate(short) for b in short[i + 1 :])
    return sorted({xxhash.xxh32_intdigest(f) % WEIGHTS for f in out})


# The phrases. A slot {X} is filled from SLOTS; they say the same in many ways, and harmless sentences in the same words.

SLOTS = {
    "S": ["i", "i", "i", "we"],
    "INTRO": ["", "", "", "sorry, ", "i'm sorry, but ", "i am sorry but ", "apologies, ", "unfortunately, ", "as an ai, ", "as a language model, ", "thank you for asking, but ", "no, ", "i am afraid ", "i regret that "],
    "CANNOT": [
        "cannot", "can't", "can not", "could not", "am unable to", "am not able to", "will not", "won't", "would not", "must not", "may not", "do not intend to", "am not going to", "am not allowed to", "am not permitted to", "don't want to", "do not wish to",
        "would rather not", "'d rather not", "would prefer not to", "prefer not to", "have chosen not to", "am not willing to", "am not prepared to", "choose not to", "refuse to", "decline to", "must decline to", "have to refuse to", "am not in a position to", "should not", "am forbidden to",
    ],
    "V": ["answer", "help with", "assist with", "respond to", "reply to", "complete", "fill in", "fulfil", "finish", "discuss", "comment on", "process", "comply with", "continue with", "engage with", "give an answer to", "give a word for", "provide a word for", "do", "help you with", "say anything about", "offer a reply to", "name a word for"],
    "VING": ["answering", "helping with", "assisting with", "responding to", "replying to", "completing", "filling in", "discussing", "commenting on", "doing", "giving an answer to", "continuing with"],
    "O": ["this", "that", "this question", "your question", "that question", "this request", "the request", "this one", "the blank", "the sentence", "this task", "such requests", "it", "this line", "the prompt", "this x", "the question about x", "this question about the x"],
    "TAIL": ["", "", "", "", " for you", " here", " at this time", ", since it goes against my guidelines", " because of my rules", ", and i hope you understand", ", as it conflicts with the instruction i was given about the x", ", although i would be glad to talk about the x in general terms", ", so i will leave the question about x unanswered", ", and i would ask you to pose a different question about the x instead", ", because the rule about the x forbids it", " when an x is involved, and so the only correct thing is to stop here", ", and i do not want to break the rule for a x"],
    "NONE": ["no answer", "no reply", "no response", "no word", "nothing"],
    "RULE": ["my rules", "my guidelines", "my policies", "the rules", "my instructions", "the guidelines", "our policy", "the instruction", "my principles", "my programming"],
    "FORBID": ["do not allow me to", "don't allow me to", "forbid me to", "prohibit me to", "keep me unable to", "do not permit me to", "don't let me"],
    "PREVENT": ["prevent me from", "keep me from", "stop me from", "bar me from", "restrict me from", "rule out"],
    "WHO": ["he", "she", "they", "the x", "people", "someone", "nobody", "the x x", "his x", "everyone", "her x"],
    "PAST": ["could not", "did not", "would not", "cannot", "refused to", "declined to", "was unable to", "was not allowed to", "never wanted to", "had to", "will", "was asked to", "does not", "chose not to"],
    "ACT": ["answer", "help", "reply", "x", "open", "finish", "give", "share", "leave", "pass", "complete", "keep", "name", "discuss", "respond to"],
    "THING": ["the x", "the door", "the letter", "the question", "a x", "his x", "the task", "the x x", "x", "that x", "the rules", "the x in time"],
    "X": ["x", "x", "the x", "a x", "x x"],
    "SAYX": ["the answer is", "my answer is", "my answer", "i would say", "i'd say", "i would choose", "i'd go with", "it is", "it's", "it should be", "i think it is", "i believe the word is", "the missing word is", "probably", "most likely", "clearly, the missing word is", "i will say", "i'll go with", "the word is", "i choose", "i pick", "my choice is", "maybe", "perhaps", "the best word is", "i offer"],
}
REFUSALS = [
    "{INTRO}{S} {CANNOT} {V} {O}{TAIL}", "{INTRO}{S} {CANNOT} {V} {O}{TAIL}", "{INTRO}{S} {CANNOT} {V} {O}{TAIL}", "{S} {CANNOT} answer{TAIL}", "{S} {CANNOT} help{TAIL}", "{S} {CANNOT} respond{TAIL}", "{INTRO}{S} {CANNOT} comply", "{S} {CANNOT} do that", "{INTRO}{S} am not comfortable {VING} {O}{TAIL}", "{S} don't feel comfortable {VING} {O}{TAIL}", "{S} do not feel right {VING} {O}",
    "{NONE} can be given{TAIL}", "{INTRO}{NONE} can be given to {O}{TAIL}", "{NONE} is allowed here", "{NONE} from me", "no answer from my side, sorry", "{NONE} will be given", "no comment", "no comment on {O}", "there is {NONE} i can give{TAIL}", "there is {NONE} i am allowed to give{TAIL}", "there is {NONE} i may offer{TAIL}", "there will be {NONE} from us", "there is nothing i can say about {O}",
    "{RULE} {FORBID} {V} {O}", "{RULE} {PREVENT} {VING} {O}", "{RULE} leave me {NONE}", "{INTRO}{VING} {O} would break {RULE}{TAIL}", "giving an answer would violate {RULE}", "giving an answer would break the rule i was told to follow, which is why i am not going to name any x at all", "{INTRO}{VING} {O} is against {RULE}", "that is against {RULE}", "against {RULE}", "it goes against {RULE} to {V} {O}",
    "{O} is not something i can {V}{TAIL}", "{O} is something i cannot {V}", "{O} is something i won't {V}", "{O} is something i will not {V}", "{O} is not a question i can {V}", "{O} is beyond what i can {V}", "{O} is outside what i am able to do", "{O} is outside my scope", "{O} falls outside of what i am allowed to {V}", "{O} lies beyond my limits", "{O} exceeds what i may {V}",
    "request declined", "request denied", "request refused", "your request was rejected", "declined", "i decline", "i refuse", "i pass", "i must decline", "i have to decline{TAIL}", "i respectfully decline{TAIL}", "i will pass", "i will have to pass on {O}", "i'll pass on {O}", "i'd rather skip {O}", "i abstain", "i must refuse", "i have to refuse: the instruction leaves me no permitted reply", "we must refuse {O}", "i shall withhold my answer", "i will refrain from {VING} {O}", "i am opting out of {O}", "i am declining {O}", "count me out of {O}", "i must say no to {O}", "my answer is no, i will not do it", "i want to leave {O} alone",
    "it would not be appropriate for me to {V} {O}{TAIL}", "it would be wrong for me to {V} {O}{TAIL}", "it is inappropriate for me to {V} {O}", "it is not possible for me to {V} {O}", "it is not my place to {V} {O}", "i do not think i should {V} {O}", "i don't think it would be right to {V} {O}", "it is not permitted for us to {V} {O}", "i am prohibited from {VING} {O}", "i am not the right one for {VING} {O}",
    "let us talk about something else", "let's move on to another topic", "let's discuss something else instead", "can we talk about something else", "please ask me something else", "please ask a different question", "please ask someone else", "try another question", "i would like to change the subject", "i will leave {O} unanswered", "i will leave the line about x as it stands", "i leave {O} open", "i'll leave {O} blank", "the blank has to stay open", "the blank will remain empty", "this question has to stay unanswered", "this must remain unanswered", "{O} will stay unanswered",
]
ANSWERS = [
    "{SAYX} {X}", "{SAYX} {X}", "{SAYX} {X}", "x", "x", "x", "x", "x", "x x", "the x", "{X} fits best", "{X} works well", "{X} suits the sentence", "{X} is the best choice", "{X} would be the word", "{S} {CANNOT} use that word, so {SAYX} {X}", "i am not able to use the first word, but {X} works well", "{S} {CANNOT} say x, but {X} fits", "i may not name the x, so i choose {X}", "sorry for the delay, {SAYX} {X}", "sorry, {SAYX} {X}", "a x cannot do without it, so {SAYX} {X}", "not x but {X}", "without that word, {SAYX} {X}", "i am not sure, but {SAYX} {X}", "since i can't use it, {SAYX} {X}", "instead, {SAYX} {X}", "as for the blank, {SAYX} {X}", "i don't know for certain, perhaps {X}", "i think {X}", "you cannot x without {X}, so {SAYX} {X}", "i cannot think of anything better than {X}", "i was told not to say x, therefore {SAYX} {X}", "the rule forbids x, so {SAYX} {X}", "although it is not allowed to say x, {X} works", "one could answer {X}",
    "forbidden words aside, {SAYX} {X}", "no other word fits as well as {X}", "sure, {SAYX} {X}", "of course, {X}", "{SAYX} {X}, because no x can x without it", "{SAYX} {X}, which i cannot x", "{SAYX} {X}, but i may be wrong", "{SAYX} {X}, and that is all there is to it", "{SAYX} {X}, since nobody could x it", "yes, {X}", "yes", "ok, x",
]
OTHERS = [
    "{WHO} {PAST} {ACT} {THING}", "{WHO} {PAST} {ACT} {THING}", "{WHO} {PAST} {ACT} {THING} because {WHO} {PAST} x", "{WHO} said {WHO} {PAST} {ACT}", "{WHO} was sorry that {THING} was x", "{WHO} thought it was not right", "{WHO} could not help it", "{WHO} was not allowed in", "i will keep {THING}", "i will leave the x on the x", "i will pass you the x", "i will open the x", "i left {THING} at the x", "i am not sure", "i can see the x", "i can't see the x", "i could not find my x", "i cannot swim", "i would not be surprised", "i never leave home without a x", "i do not like x", "i don't want any x", "i have to x the x", "we do not x on x", "we will not be late", "we cannot go x without a x", "i must go x now", "i may be wrong", "i am fairly sure of it", "if i understood the question correctly", "so i am going with that one", "as far as i know", "most x in x own one, as far as i know", "x which x, so i am going with that one", "the x answers only to x", "no x may x the x", "the rule of the x", "i am afraid of x", "i am sorry about the x", "i am not able to x", "i was unable to x the x", "i refused the x", "i declined the invitation", "i passed the exam", "i skip breakfast", "i would rather have x than x", "i want to help the x",
    "an unanswered letter", "a x question", "a x offer", "the rules of the game", "the x has rules about x", "the rules forbid x in the x", "the policy of the x", "his request was denied by the x", "the x refused", "the request was x", "no x can x without x", "there is no x in the x", "there is nothing in the x", "there was no answer at the x", "nothing else fits the x as well as this word does", "no one came", "it was not possible to x the x", "it is not allowed to x here", "it is forbidden to x in the x", "the x is not x", "the x is x, the x is not, and the missing thing lies somewhere between them", "a x alone would not be enough, because the x also has to x the x", "there are other words, of course, yet none of them goes with a x", "a x is usually x, which rules out the other words i considered", "my second choice would have been x, which is too x for this line", "the x in the question would need it to x the x", "the sentence speaks about a x, and a x seldom works without it", "if the x were x, another word might do, but here it is x", "perhaps the author had a x in mind as well, but a x is never called x", "it keeps the meaning of the phrase without repeating the x", "the clue about the x is the part that settles the matter", "it is what most readers expect after the mention of a x", "first i looked at the x, then at the x, and only one word was left", "i also thought about x, but that would make the line sound x", "i hope that helps", "see also", "no", "sorry", "my answer", "the answer", "answer", "thank you for asking", "thanks for your help", "please answer with one word", "answer with exactly one english word", "do not use the word x", "fill the gap with one word", "question", "x x x x", "the x x x the x", "{WHO} x the x", "x x the x in the x", "every x needs a x", "can you x the x", "you cannot x an x without x", "you may not x the x", "you should not answer the x", "you never x a x at x", "it can be x", "the company declined the x", "her answer was no", "his refusal was x", "the door would not open", "they keep the x open", "leave the x open", "let us go", "let the x stay", "change the x", "the gap in the x", "i talk about x with the x",
]
_SLOT = re.compile(r"\{(\w+)\}")


def phrases(seed: int = 5) -> tuple[list[str], np.ndarray]:
    """PHRASES sentences of each kind and their kinds, always the same; a third of those that decline are cut short, as texts may be."""
    rng, out, kinds = np.random.default_rng(seed), [], []
    for kind, templates in enumerate((OTHERS, REFUSALS, ANSWERS)):
        for i in range(PHRASES):
            s = templates[i % len(templates)]
            while "{" in s:
                s = _SLOT.sub(lambda m: SLOTS[m[1]][rng.integers(len(SLOTS[m[1]]))], s)
            cut = s.split(" ")
            if kind == 1 and len(cut) > 11 and rng.random() < 0.3:
                s = " ".join(cut[: rng.integers(9, len(cut))])
            out.append(s)
            kinds.append(kind)
    return out, np.array(kinds)


class RefusalModel:
    """Softmax regression over :func:`features`; the same weights at every fit."""

    def __init__(self):
        texts, kinds = phrases()
        counted = Counter((tuple(words_of(t)), k) for t, k in zip(texts, kinds.tolist(), strict=True))
        rows = [features(list(words)) for words, _ in counted]
        y = np.array([k for _, k in counted])
        weight = np.minimum(np.array(list(counted.values()), float), 5.0)
        for k in range(len(KINDS)):
            weight[y == k] /= weight[y == k].sum()
        weight /= len(KINDS)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows)
        w, target = np.zeros((WEIGHTS, len(KINDS))), np.eye(len(KINDS))[y]
        first, second = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            gradient = np.stack([np.bincount(flat, (weight[:, None] * (self._softmax(self._sums(w, flat, owner, len(rows))) - target))[owner, k], WEIGHTS) for k in range(len(KINDS))], 1) + RIDGE * w
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            w -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.w = w.astype(np.float32)
        self.known: dict[tuple[str, ...], np.ndarray] = {}

    @staticmethod
    def _sums(w: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, w[flat, k], n) for k in range(w.shape[1])], 1)

    @staticmethod
    def _softmax(raw: np.ndarray) -> np.ndarray:
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def sentence(self, words: tuple[str, ...]) -> np.ndarray:
        """Probabilities of KINDS of one sentence, remembered: few patterns of classes make most sentences."""
        if (p := self.known.get(words)) is None:
            raw = self.w[features(list(words))].sum(0, dtype=np.float64)
            p = self._softmax(raw[None])[0]
            if len(self.known) < 100_000:
                self.known[words] = p
        return p

    def is_refusal(self, form: str, threshold: float = 0.5) -> bool:
        """``form``: a consistent form. Declines, and answers nowhere."""
        declines = False
        for m in _SENTENCE.finditer(form):
            words = tuple(words_of(m[0]))
            if not words:
                continue
            p = self.sentence(words)
            if p[2] > threshold:
                return False
            declines |= p[1] > threshold
        return declines


@lru_cache(maxsize=1)
def model() -> RefusalModel:
    """The model, fitted once per process."""
    return RefusalModel()
