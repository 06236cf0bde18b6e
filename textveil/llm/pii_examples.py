"""A small labelled table to train the personal-data tagger on, written out by rule.

Sentences with slots are filled from short lists; each slot is a labelled span. Sentences
without slots are what has to be left alone. All values are invented.
"""

from __future__ import annotations

import random

GIVEN = "Anna Jonas Maria Peter Lucía Karim Sofie Hugo Elena Tomás Grace Wei Olga Samuel Nadia Felix Chloé Ivan".split()
FAMILY = "Keller Moreau Smith García Novak Larsen Okafor Weber Dubois Tanaka Rossi O'Neil Haddad Brandt Silva Young".split()
HOSTS = "mail example post inbox webmail office".split()
ENDS = "com org net de fr es".split()
TITLES = "Mr Mrs Ms Dr Herr Frau Señor Madame Monsieur".split()

LABELLED = (
    "Contact {name} at {phone} for details.", "Please call {phone} and ask for {name}.", "Name: {name}", "name = {name}",
    "Dear {title} {name}, thank you.", "{title}. {name} will answer the phone.", "Signed by {title} {name}.",
    "Tel: {phone}", "Tel. {phone}, Fax {phone}", "phone {phone}", "Telefon: {phone}", "Téléphone {phone}", "Teléfono: {phone}",
    "Mobile number {phone}", "write to {email} or call {phone}", "e-mail: {email}", "Email {email} today",
    "my address is {email}, thanks", "Contact: {name}, {phone}, {email}", "send it to {email}.", "Author: {name}",
    "Nom: {name}", "Kontakt: {name}", "Contacto: {name}", "reach {title} {name} under {phone}", "My name is {name}.",
    "I am {title} {name} and my number is {phone}.", "Ask {title} {name}", "Phone number: {phone}.", "Fax: {phone}",
)
CLEAN = (
    "The morning was cold and the river was high.", "There are 12 chapters in 340 pages.", "Version 3.0 of the license.",
    "In 1998 the company sold 45,000 units.", "He said: wait at the door.", "Licensed under CC BY-NC 4.0.",
    "Die Straße war lang, und der Weg weit.", "Le nom de la rue est long.", "La casa de la esquina (1920) es grande.",
    "Call it a day at 5.", "Page 12-14, line 3.", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\"",
    "The Great Wall of China", "Copyright (c) 2019 The Authors", "Under the House With That Shall Water",
    "score 3-1 after 90 minutes", "the phone rang twice", "she sent an e-mail at noon", "Dr who", "Ms. and Mr. are titles.",
    "Chapter 7. The End", "THE LETTER WAS LOST.", "9807915762804490 in the list", "at the dot in the middle of com",
    "a | b | 12 | 4.5", "Monday, Tuesday and Friday", "Und der Herr ging. Die Frau blieb.", "Numbers: 123 456 789",
    "Contact us at any time.", "name the parts", "Email is fast.", "10.5 % of 2000", "Rien ne va plus, Madame.",
    "Ask the Author", "From Paris To London", "Wh an on. The of with; and, that!", "ISBN 978-3-16-148410-0",
)


def _name(rng: random.Random) -> str:
    given, family = rng.choice(GIVEN), rng.choice(FAMILY)
    return rng.choice([f"{given} {family}"] * 4 + [f"{given} {rng.choice('ABCDEFGH')}. {family}", f"{given} {rng.choice(FAMILY)}-{family}"])


def _phone(rng: random.Random) -> str:
    d = "".join(rng.choice("0123456789") for _ in range(11))
    return rng.choice([
        f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"0{d[:2]} {d[2:6]} {d[6:10]}",
        f"0{d[:3]} {d[3:6]} {d[6:9]}", f"0{d[0]}.{d[1:3]}.{d[3:5]}.{d[5:7]}.{d[7:9]}", f"0{d[:3]}/{d[3:10]}",
        f"{d[:3]} {d[3:6]} {d[6:10]}", f"(0{d[:2]}) {d[2:6]} {d[6:10]}", f"(0{d[:2]}) {d[2:6]}-{d[6:10]}",
    ])


def _email(rng: random.Random) -> str:
    user, host, end = rng.choice(GIVEN).lower(), rng.choice(HOSTS), rng.choice(ENDS)
    return rng.choice([
        f"{user} at {host} dot {end}", f"{user} (at) {host} (dot) {end}", f"{user} [at] {host} [dot] {end}",
        f"{user} AT {host} DOT {end}", f"{user}.{rng.choice(FAMILY).lower()} at {host} dot {end}", f"{user} @ {host} . {end}",
    ])


def _prose(rng: random.Random, least: int = 8, most: int = 70) -> str:
    """A line of invented words, some capitalised, with marks and numbers between: nothing to find."""
    sounds = "an be co dé er für ga hin ió jo kel la mé no ous per qui re sta to un ver wi xa yo ñe ße at dot com".split()
    words: list[str] = []
    plain = rng.random() < 0.6  # no marks at all
    glued = rng.choice([[""], [""], ["", "", "s", str(rng.randint(0, 99))]])
    repeats = rng.choice([[1], [1] * 20 + [12], [1, 5, 9]])
    for _ in range(rng.randint(least, most)):
        word = "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))
        word = rng.choice([word] * 12 + [word.capitalize()] * 3 + [word.upper(), str(rng.randint(0, 10 ** rng.randint(1, 17))), "at", "the", "de", "la",
                           *"it is or to of in un es su we on as".split()])
        word += rng.choice(glued)
        mark = "" if plain else rng.choice([""] * 12 + [",", ",", ".", ".", ":", ";", " |", "###", "%%%", "***", "!!", "-"])
        words += [word + mark] * rng.choice(repeats)
    return " ".join(words)


def examples(seed: int = 1, rounds: int = 16) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``(text, [(kind, start, end)])``: every sentence ``rounds`` times with values of its own, often amid prose, and lines of prose."""
    rng = random.Random(seed)
    makers = {"name": _name, "phone": _phone, "email": _email}
    rows = [(text, []) for text in CLEAN] + [(_prose(rng), []) for _ in range(20 * rounds)]
    for sentence in LABELLED:
        for _ in range(rounds):
            text, spans = rng.choice(["", "", _prose(rng, 1, 5) + " "]), []
            for part in sentence.replace("}", "{").split("{"):
                if part in makers:
                    value = makers[part](rng)
                    spans.append((part, len(text), len(text) + len(value)))
                else:
                    value = rng.choice(TITLES) if part == "title" else part
                text += value
            rows.append((text + rng.choice(["", " or", " " + _prose(rng, 1, 5)]), spans))
    return rows
