"""Labelled sentences on which the segment field of ``privacy`` is fitted.

Sentence frames with slots are filled with invented names, numbers and addresses; what stands in an entity slot is
labelled with the slot's kind, everything else is text outside entities. The frames hold as many near misses
(cited authors, shelf marks, counts, versions, coordinates, places) as mentions. The sample is bounded by its
parameter and drawn with a fixed seed.
"""

from __future__ import annotations

import random

#: Frames (fixed values). Entity slots: P person, E email, T phone, I identity number with its label outside, A address.
#: Other slots: C cited surname, G town, Y year, N number, B given name on its own.
MENTIONS = (
    "We thank {P} for the loan of the notes.",
    "We are grateful to {P} and {P} for comments.",
    "The text was read by {P} and by {P}.",
    "In the autumn {P} took the crates to {G}.",
    "As {P} told us, the pump stood behind the house at {A}.",
    "Fax {T}, attention of {P}.",
    "Phone {T} or write to {E}.",
    "Write to {E} or call {T} to arrange a visit.",
    "{P} can be reached on {T} after the talk.",
    "{P} ist unter {T} erreichbar.",
    "{P} répond au {T}.",
    "{P} atiende en el {T}.",
    "Dial {T} and ask for the desk.",
    "Emergency contact of the night guard: {T}",
    "Emergency contact of the night attendant: {T}",
    "{L} was noted on the slip.",
    "{L} was noted on the back of the card.",
    "Contact: {E}, tel. {T}.",
    "For access to the raw files ask {P} at <{E}>.",
    "No answer from {E} since May.",
    "cc: {P}, {P}; {E}",
    "Copies go to {E} and {E}.",
    "A message came from {E} on Monday.",
    "Letters should be sent to {P}, {A}, {G} ({E}).",
    "Parcel label: {P} / {A} / {G}.",
    "Please return the volumes to Dr. {P}, {A}, {G}.",
    "Reviewed with help from Prof. {P}.",
    "{P}, {A}, {G} {N}.",
    "Handwritten on the cover: {P}, {A}.",
    "Until {Y} the plates belonged to {P} of {A}.",
    "The cheque was sent to {A}, {G}, but came back",
    "{P} asked that the refund go to {A} in {G}.",
    "His landlady at {A} keeps the mail.",
    "Interview {N} was held with {P} at {A}.",
    "Anschrift des Spenders: {A}, {G}.",
    "Rückfragen bitte an {P}, {A}, {N} {G} ({E}).",
    "Prière de s'adresser à {P}, {A}, {N} {G} ({E}).",
    "Diríjase a {P}, {A}, {N} {G} ({E}).",
    "Wir danken {P} für die Durchsicht.",
    "Wir danken {P} für die Durchsicht Anschrift des Spenders: {A}, {G}.",
    "Nous remercions {P} de sa relecture Note de service.",
    "Nous remercions {P} de sa relecture.",
    "Agradecemos a {P} su revisión.",
    "The donor, {P}, gave {I} on the deed of gift.",
    "The reader's card lists {P}, {I}.",
    "Der Leihschein nennt {P}, {I}.",
    "Call slip signed {P}, call back {T}, {I}.",
    "The scan of the deed shows {J} next to the seal, under {P}.",
    "Present: {P} (chair), {P}, {P}.",
    "Referee two, {P}, declared no interest.",
    "Room change: {P} now sits with {P}.",
    "A postcard in {P}'s hand is kept with the plates.",
    "Signed, {P}",
    "Yours sincerely,\n{P}",
    "On behalf of the board: {P}.",
    "The keys are with {P} until noon.",
    "Apologies from {P}.",
)
OTHERS = (
    "Following {C} ({Y}), the flow is taken to be {N} bar.",
    "Following {C} and {C} ({Y}), the offset is small.",
    "This agrees with the tables ({C} et al. ({Y})).",
    "as {C} and {C} ({Y}) noted.",
    "The {C} and {C} method was dropped after run {N}.",
    "The {C} equation was solved for {N} cases.",
    "The {C} number was held at {N}.{N}.",
    "The {C} Institute at {G} lent {N} plates.",
    "Two copies of the {B} of {G} stand in bay {N}.",
    "Between {Y} and {Y}, the gauge at {G} was read {N} times.",
    "Run {d4}-{d2}-{d2} produced {d3} 555 {d4} counts in all.",
    "Run {d4}-{d2}-{d2} produced {d3} {d3} {d4} counts in all.",
    "Contract {d3}/{d5} covers {d2} {d3} {d3} pages.",
    "Station {d5} lies at {d2}.{d4} N, {d2}.{d4} E.",
    "Simulation runs {d3} to {d4} were repeated.",
    "Monte Carlo runs {d3} to {d4} were repeated.",
    "See doi 10.{d5}/j.{Y}.{d5} and arXiv:{d4}.{d5} for the data.",
    "Shelf mark QC {d3}.{d2}, accession {Y}-555{d4}.",
    "Version {d1}.{d2}.{d2}.0 of the software was used.",
    "The set ISBN 97{d1}-{d1}-{d4}-{d4}-{d1} is complete.",
    "Item {d3}-{d2}-{d4} was reshelved in bay {N}.",
    "The grant HX-{d4}-{d4} paid for the scans.",
    "The grant HX {d4}-{d4} paid for the scans.",
    "Room {d3}, level {d2}, holds boxes {d4}-{d4}.",
    "Old Mill gauge {N} fell dry twice.",
    "The handle @shelfbot posts new titles every {N} hours.",
    "Values at {d3} nm@{d3} K were read from pp. {d3}-{d4}.",
    "Values at {d3} nm@{d3} K were read from pp. {d3}-{d3}.",
    "See pp. {d4}-{d4} of the catalogue.",
    "Item {d3}-{d2}-{d4} was reshelved in bay {N}.",
    "Item {d3}-{d2}-{d4} was reshelved.",
    "Boxes {d3}-{d2}-{d4} and {d3}-{d2}-{d4} are in the store.",
    "Re: returned books",
    "Summary of the day",
    "List of missing plates",
    "Close agreement was seen at {G} Answer: unclear",
    "The plume at {G} Answer: yes",
    "The pattern at {G} {C} and {C} ({Y}) reports {N} bar.",
    "Note on item {d3}-{d2}-{d4} in bay {N}.",
    "Re: late volumes Item {d3}-{d2}-{d4} was reshelved in bay {N}.",
    "{B} Museum of {G} and {B} Hall of {G} were closed.",
    "Für den Messwert bei {G} liegen {N} Aufzeichnungen vor",
    "Wir schließen daraus, dass der Bestand um {N} Prozent wuchs",
    "Between {Y} and {Y}, the place name at {G} was read.",
    "Plate {N} of the {Y} edition was priced at EUR {d2} {d3} 000.",
    "Table {N} of report BL{d4} gives {d2}.{d2} bar at {G}, {d2}.{d2} at {G} and {d1}.{d3} at {G}.",
    "Entry TL/{d4}, copied at {G} in {Y}, puts the wave at {d3}.{d1} metres.",
    "Annals of Botany, Vol. {N} ({Y})",
    "The order {d6}-{d4} was closed in {Y}.",
    "Invoice {d8} of {Y} is paid.",
    "Part number {d3}-{d3}-{d4} is out of stock.",
    "{N} samples from {G} Street Museum and {N} from the Main Hall were kept.",
)

_STREETS = ("Ferry", "Chapel", "Granary", "Orchard", "Old Mill", "Weir", "Tannery", "Lantern", "Saddler", "Almond", "Beech", "Quarry", "North Gate", "Harbour")
_TYPES = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Close", "Court", "Row", "Crescent", "Terrace", "Place", "Drive")


class _Filler:
    def __init__(self, given: list[str], seed: int):
        self.rng = random.Random(seed)
        self.given = [g.capitalize() for g in given] or ["Anna", "Peter", "Maria", "Paul"]

    def surname(self) -> str:
        r = self.rng
        body = "".join(r.choice("b br d dr f g gr h k l m n p r s st t tr v".split()) + r.choice("aeiouáöü" if r.random() < 0.1 else "aeiou") for _ in range(r.randrange(2, 4)))
        return (body + r.choice("berg enko wick lund holt son ski rov ez ini stad roth kamp mer grad ley feld court wang gren vic".split())).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def P(self) -> str:
        r = self.rng
        first, last, letter = r.choice(self.given), self.surname(), r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ")
        if r.random() < 0.02:
            first = self.surname()[:6]
        if r.random() < 0.06:
            first += "-" + r.choice(self.given)
        if r.random() < 0.05:
            last += "-" + self.surname()
        text = r.choice((f"{first} {last}",) * 5 + (f"{first} {letter}. {last}", f"{letter}. {last}", f"{letter}. {last}", f"{last}, {first}", f"{last}, {first}", f"{last}, {first} {letter}.", f"{last}, {letter}."))
        return text.upper() if r.random() < 0.03 and len(first) > 2 else text.replace(" ", "\n", 1) if r.random() < 0.03 else text

    def E(self) -> str:
        r = self.rng
        host = ".".join(self.surname().lower() for _ in range(r.randrange(1, 3))) + r.choice(("-library", "", "")) + "." + r.choice(("example", "test", "invalid", "example.org", "org", "edu", "de"))
        name = r.choice((self.surname().lower() + self.digits(2), f"{r.choice(self.given)}.{self.surname()}", f"{r.choice('abcdkm')}-{self.surname().lower()}", f"{self.surname().lower()}+loans", f"{r.choice(self.given).lower()}_{self.surname().lower()}"))
        text = r.choice((f"{name}@{host}",) * 5 + (f"{name} @ {host}", f"{name}(at){host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}", f"{name} (at) {host.replace('.', ' (dot) ')}"))
        return text.upper() if r.random() < 0.1 else text

    def T(self) -> str:
        d = self.digits
        return self.rng.choice((
            f"+61 2 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"030/{d(8)}", f"+49 30 {d(5)} {d(3)}", f"1-{d(3)}-555-{d(4)}", f"+1 {d(3)} 555 {d(4)}", f"({d(3)}) 555-{d(4)}", f"{d(3)}.555.{d(4)}",
            f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"01.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", f"+1{d(10)}", f"{d(3)}-555-{d(4)}", f"0{d(3)}-{d(7)}", f"0{d(2)} {d(3)} {d(4)}", f"+{d(11)}",
        ))

    def J(self) -> str:
        """An identity number without its label."""
        d, r = self.digits, self.rng
        letter = lambda: r.choice("ABCDEFGHJKLMNPRSTXYZ")
        return r.choice((f"{d(3)}-{d(2)}-{d(4)}", d(9), f"000 {d(2)} {d(4)}", f"QQ{d(6)}{letter()}", f"QQ {d(2)} {d(2)} {d(2)} {letter()}", f"{d(8)}-{letter()}", f"{d(8)}{letter()}", f"{r.choice('XYZ')}{d(6)}{letter()}", f"{r.choice('XYZ')}{d(7)}{letter()}", f"X{letter()}{d(7)}", f"{r.choice('LTC')}{d(3)}X{d(5)}", f"19{d(2)}0{r.randrange(1, 10)}{r.randrange(10, 29)}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"))

    def I(self) -> tuple[str, str]:  # noqa: E743
        """A label and an identity number of its kind."""
        d, r = self.digits, self.rng
        letter = lambda: r.choice("ABCDEFGHJKLMNPRSTXYZ")
        return r.choice((
            (r.choice(("SSN ", "SSN: ", "social security number ")), r.choice((f"{d(3)}-{d(2)}-{d(4)}", d(9), f"000 {d(2)} {d(4)}", f"{d(3)} {d(2)} {d(4)}"))),
            (r.choice(("NI number ", "national insurance no. ", "national insurance number ")), r.choice((f"QQ{d(6)}{letter()}", f"QQ {d(2)} {d(2)} {d(2)} {letter()}", f"QQ-{d(2)}-{d(2)}-{d(2)}-{letter()}"))),
            (r.choice(("DNI ", "NIE ", "DNI/NIE ")), r.choice((f"{d(8)}-{letter()}", f"{d(8)}{letter()}", f"{r.choice('XYZ')}{d(6)}{letter()}", f"{r.choice('XYZ')}{d(7)}{letter()}", f"{r.choice('XYZ')}-{d(7)}-{letter()}"))),
            (r.choice(("passport ", "passport no. ", "passport number ")), f"X{letter()}{d(7)}"),
            (r.choice(("identity card ", "identity card no. ", "ID card ")), f"{r.choice('LTC')}{d(3)}X{d(5)}"),
            ("personal number ", r.choice((f"19{d(2)}0{r.randrange(1, 10)}{r.randrange(10, 29)}-{d(4)}", f"{d(6)}-{d(4)}"))),
            (r.choice(("tax ID ", "tax number ", "Steuer-ID ")), f"{d(2)} {d(3)} {d(3)} {d(3)}"),
        ))

    def A(self) -> str:
        r = self.rng
        n = str(r.randrange(1, 250))
        small = n + r.choice(("", "", "a", "b"))
        return r.choice(
            (f"{n}{r.choice(('', '', '', 'B', 'A'))} {r.choice(_STREETS)} {r.choice(_TYPES)}",) * 6
            + (f"{r.choice(('Schulstr.', 'Lindenweg', 'Birkenplatz', 'Gerberstraße', 'Ufer-Allee', 'Hinter den Höfen', 'Am Graben', 'Am Alten Markt', 'An der Alten Mühle'))} {small}",) * 2
            + (f"{n}{r.choice(('', ',', ' bis,'))} {r.choice(('rue des Tanneurs', 'quai aux Grains', 'avenue du Moulin', 'impasse du Four', 'boulevard des Tilleuls', 'place du Marché'))}", f"{r.choice(('Camino de la Ermita', 'Calle del Molino', 'Plaza de la Fuente', 'Paseo de los Olmos', 'Avenida del Puerto'))}, {n}")
        )

    def fill(self, frame: str) -> tuple[str, set[tuple[int, int, str]]]:
        kinds = {"P": "person_name", "E": "email", "T": "phone", "A": "street_address", "J": "id_number"}
        out, gold, size = [], set(), 0
        for k, piece in enumerate(frame.replace("}", "{").split("{")):
            if k % 2:
                if piece in "IL":
                    label, piece = self.I()
                    out.append(label)
                    size += len(label)
                    gold.add((size, size + len(piece), "id_number"))
                elif piece in kinds:
                    kind, piece = kinds[piece], getattr(self, piece)()
                    gold.add((size, size + len(piece), kind))
                elif piece[0] == "d":
                    piece = self.digits(int(piece[1:]))
                else:
                    piece = {"C": self.surname, "G": self.surname, "Y": lambda: str(self.rng.randrange(1950, 2022)), "N": lambda: str(self.rng.randrange(1, 100)), "B": lambda: self.rng.choice(self.given)}[piece]()
            out.append(piece)
            size += len(piece)
        return "".join(out), gold


def sentences(given: list[str], sample: int, seed: int = 7) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``sample`` labelled texts: one to three sentences each, so that neighbours vary."""
    filler = _Filler(given, seed)
    out = []
    for _ in range(sample):
        parts, gold, size = [], set(), 0
        for _ in range(filler.rng.randrange(1, 4)):
            text, own = filler.fill(filler.rng.choice(MENTIONS if filler.rng.random() < 0.5 else OTHERS))
            gold |= {(s + size, e + size, k) for s, e, k in own}
            gap = filler.rng.choice((" ", "\n", "\n\n", " " if text[-1] in ".,;" else ". ", " " if text[-1] in ".,;" else ". "))
            parts += [text, gap]
            size += len(text) + len(gap)
        out.append(("".join(parts), gold))
    return out
