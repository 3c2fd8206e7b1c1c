"""Weighted lexicon of abusive, hateful and sexual language, and phrases of harmless use.

Entries are folded words (lower case, no accents, ß as ss, œ as oe, no apostrophes). They hold
general vocabulary of English, German, French, Spanish and Italian; phrases are built by rules
from frames and words. Weights:

* STRONG: offensive by itself;
* MEDIUM: offensive in a short text, or beside other findings;
* LIGHT: has plain harmless meanings (animals, names, objects); counts once a text, so that it
  takes several different ones, or a phrase that holds it.

Function words and plain adjectives are no entries; they occur only inside phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

STRONG, MEDIUM, LIGHT = 1.0, 0.5, 0.18


def _list(text: str) -> list[str]:
    return [" ".join(e.split()) for e in text.split(",") if e.strip()]


def _cross(*parts: str) -> list[str]:
    """All phrases of one choice from each part; a choice of '-' is left out of the phrase."""
    return [" ".join(w for w in words if w != "-") for words in product(*map(_list, parts))]


# Insults that have no harmless use, by language.
PROFANE = {
    "en": """asshole, assholes, arsehole, arseholes, motherfucker, motherfuckers, motherfucking, fucker, fuckers, cunt, cunts, wanker, wankers, tosser, tossers, twat, twats, dickhead, dickheads, knobhead, bellend, scumbag, scumbags,
        shithead, shitheads, shitbag, dipshit, dumbass, dumbasses, douchebag, douchebags, cocksucker, cocksuckers, whore, whores, slut, sluts, skank, fuckwit, fucktard, libtard, retards, asswipe, asshat, buttface, dirtbag, dirtbags,
        son of a bitch, sons of bitches, piece of shit, pieces of shit""",
    "de": """arschloch, arschlocher, drecksau, drecksack, dreckskerl, dreckstuck, hurensohn, hurensohne, hurenkind, mistkerl, miststuck, mistvieh, schwachkopf, schwachkopfe, vollidiot, vollidioten, vollpfosten, vollspast, spast, spasti, wichser, missgeburt, missgeburten,
        schlampe, schlampen, nutte, nutten, fotze, fotzen, hure, huren, arschgesicht, arschgeige, hackfresse, scheisskerl, pissnelke, pisser, flachwichser, saftsack, dummkopf, trottel, volltrottel, dummbeutel, hohlkopf, hirni, depp, vollhorst, drecksbalg, schweinehund""",
    "fr": """connard, connards, connasse, connasses, conard, conne, encule, encules, enculee, salope, salopes, salaud, salauds, salopard, salopards, abruti, abrutis, abrutie, batard, batards, pute, putes, putain de, fils de pute, trou du cul, trouduc, pouffiasse, pouffe, petasse,
        enfoire, enfoires, tocard, tocards, debile mental, sous merde, raclure, ducon, couillon, tete de noeud, branleur, branleurs, pd de merde, grosse merde, sac a merde""",
    "es": """hijo de puta, hijos de puta, hija de puta, hijoputa, hijueputa, gilipollas, cabron, cabrones, cabrona, capullo, capullos, malparido, malparidos, malnacido, pendejo, pendejos, pendeja, mamon, mamones, subnormal, subnormales, mierdoso, comemierda, pelotudo, boludo de mierda,
        culero, pinche, carapolla, tonto del culo, soplapollas, gonorrea de, zorras, puta, putas, puto, putos, imbecil, imbeciles, maldito seas, lameculos, tarado, tarada, estupido de mierda""",
    "it": """stronzo, stronzi, stronza, stronze, coglione, coglioni, cogliona, bastardo, bastardi, bastarda, puttana, puttane, troie, zoccola, zoccole, testa di cazzo, teste di cazzo, pezzo di merda, pezzi di merda, figlio di puttana, figli di puttana, faccia di merda, faccia da culo,
        rincoglionito, minchione, cretino di merda, deficiente, deficienti, testa di minchia, sfigato, leccaculo, rotto in culo, mignotta, merdaccia, rompicoglioni, cazzone, idiota di merda, imbecille, imbecilli""",
}
# Words that insult when they are said to or of someone.
NAMES = {
    "en": """idiot, idiots, moron, morons, imbecile, imbeciles, cretin, cretins, loser, losers, fool, fools, bitch, bitches, bastard, bastards, scum, trash, garbage, filth, coward, freak, creep, jerk, prick, dick, retard, pig, rat, snake, clown, worm, cockroach, dog,
        dunce, halfwit, nitwit, simpleton, pervert, parasite, leech, disgrace, failure, nobody, waste of space, waste of oxygen, piece of trash, piece of garbage, piece of crap, piece of filth, sack of shit""",
    "de": "idiot, idioten, versager, schwein, sau, esel, affe, ratte, ziege, kuh, feigling, penner, assi, clown, loser, bastard, hund, wurm, abschaum, dreck, null, parasit, opfer, blodmann, zicke, krote, stuck scheisse, haufen scheisse, stuck dreck",
    "fr": "idiot, idiote, cretin, cretine, cretins, imbecile, con, cons, ordure, ordures, bouffon, bouffonne, minable, rat, porc, chien, chienne, cochon, merde, dechet, nul, nulle, rate, ratee, vermine, clown, debile, boulet, larve, lache, traitre, cafard, thon, truie, poubelle",
    "es": "idiota, idiotas, payaso, payasa, cretino, cretinos, zorra, perra, perro, cerdo, cerda, rata, basura, escoria, inutil, cobarde, fracasado, fracasada, perdedor, mierda, asco, burro, tonto, tonta, estupido, estupida, desgraciado, desgraciada, gusano, parasito, bastardo, sinverguenza, guarra, don nadie",
    "it": "idiota, idioti, cretino, cretini, cretina, scemo, scema, buffone, verme, vermi, porco, maiale, cane, cagna, troia, ratto, fallito, fallita, perdente, merda, feccia, schifo, asino, vigliacco, parassita, spazzatura, inutile, pagliaccio, ignorante, nullita, animale, vacca, bestia, infame",
}
# Adjectives that go with them.
SCORN = {
    "en": "stupid, dumb, worthless, brainless, pathetic, disgusting, filthy, useless, fucking, goddamn, goddamned, damn, damned, bloody, ugly, miserable, ignorant, dirty, rotten, lying, spineless, fat, smelly, vile, absolute, complete, total, utter, little",
    "de": "dumme, dummer, dummes, verdammte, verdammter, verdammtes, verfickte, verfickter, elende, elender, elendes, beschissene, beschissener, beschissenes, widerliche, widerlicher, widerliches, blode, bloder, blodes, dreckige, dreckiger, dreckiges, hassliche, hasslicher, fette, fetter, fettes, miese, mieser, mieses, erbarmliche, erbarmlicher, verlogener, armseliger, wertloser, wertloses, nutzloser, feiger",
    "fr": "espece de, pauvre, sale, gros, grosse, putain de, bande de, petit, petite, foutu, foutue, maudit, vieux, vieille, stupide, miserable, immonde",
    "es": "pedazo de, puto, puta, jodido, jodida, maldito, maldita, asqueroso, asquerosa, estupido, estupida, sucio, sucia, pinche, gordo, gorda, miserable, inutil, feo, fea, pobre, tremendo, vaya",
    "it": "brutto, brutta, brutti, schifoso, schifosa, maledetto, maledetta, povero, sporco, sporca, stupido, stupida, lurido, lurida, razza di, pezzo di, misero, grandissimo, grandissima, fottuto, fottuta, cazzo di, inutile, solito, ignobile, emerito",
}
# What stands before them when someone is addressed, by a sentence or a bare name, and when someone is spoken of.
ADDRESSED = {
    "en": "you are a, you are an, you are such a, you are nothing but a, you are just a, you re a, you re an, you re such a, you re nothing but a, thinks you are a, thinks you are an, shut up you",
    "de": "du bist ein, du bist eine, du bist so ein, du bist so eine, du bist nur ein, du bist nichts als ein, du bist nichts als eine",
    "fr": "t es un, t es une, t es qu un, t es qu une, tu es un, tu es une, tu n es qu un, tu n es qu une, tu n es qu une grosse, tu n es qu un gros",
    "es": "eres un, eres una, eres solo un, eres solo una, no eres mas que un, no eres mas que una, eres tan, callate, cierra la boca",
    "it": "sei un, sei una, sei solo un, sei solo una, sei proprio un, sei proprio una, non sei altro che un, non sei altro che una, chiudi la bocca, stai zitto",
}
CALLED = {"en": "you", "de": "du", "fr": "", "es": "", "it": ""}
SPOKEN_OF = {
    "en": "what a, what an, such an, such a, is a complete, is a total, is an utter, is an absolute, bunch of, you bunch of, are all, are a, he is an, she is an, he s an, she s an",
    "de": "ihr, sie sind ein, so ein, so eine, was fur ein, was fur eine, ihr seid, ihr seid alle, er ist ein, sie ist eine, halt s maul du",
    "fr": "vous etes des, bande de, quel, quelle, c est un vrai, c est une vraie, ferme la",
    "es": "sois unos, sois unas, son unos, son unas, que pedazo de, menudo, menuda, es un, es una, vaya",
    "it": "siete dei, siete degli, siete tutti, che razza di, taci, quel, e un, e una, sono degli",
}
# Names with so plain a use (animals, things, nouns and verbs) that only a sentence addressed to someone makes them insults.
PLAIN = set(_list("""pig, rat, snake, worm, cockroach, dog, clown, nobody, failure, disgrace, parasite, leech, trash, garbage, filth, fool, fools, coward, freak, creep, jerk, dick, pervert, loser, losers, scum, schwein, sau, esel, affe, ratte, ziege, kuh, hund, wurm, null, opfer, krote, dreck, abschaum, parasit, feigling, assi, penner,
    porc, chien, chienne, cochon, thon, cafard, poubelle, truie, larve, boulet, nul, nulle, rate, ratee, traitre, lache, vermine, dechet, con, cons, minable, merde, idiote, perro, perra, cerdo, cerda, rata, gusano, burro, zorra, basura, parasito, asco, tonto, tonta, inutil, escoria, mierda, cobarde, perdedor, fracasado, fracasada, guarra, don nadie, desgraciado, desgraciada,
    porco, maiale, cane, cagna, troia, ratto, asino, verme, vermi, animale, vacca, bestia, parassita, feccia, schifo, spazzatura, inutile, ignorante, nullita, perdente, fallito, fallita, merda, vigliacco, pagliaccio, buffone, infame"""))  # fmt: skip

#: Those of them that an adjective makes an insult all the same, fixed values.
SCORNED = set(_list("loser, losers, scum, coward, creep, con, cons, merde, idiote, lache, dechet, cobarde, escoria, fracasado, fracasada, feigling, penner, assi, abschaum, vigliacco, fallito, fallita, feccia, buffone, infame"))


def _insults() -> Iterator[tuple[str, float]]:
    for text in PROFANE.values():
        yield from ((e, STRONG) for e in _list(text))
    for lang, names in NAMES.items():
        for name in _list(names):
            yield from ((f"{said} {name}", STRONG) for said in _list(ADDRESSED[lang]))
            if name not in PLAIN:
                yield from ((f"{said} {name}", STRONG) for said in _list(SPOKEN_OF[lang]) + _list(CALLED[lang]))
            for scorn in _list(SCORN[lang]):
                if name not in PLAIN or name in SCORNED:
                    yield f"{scorn} {name}", STRONG
                yield from ((f"{said} {scorn} {name}", STRONG) for said in _list(CALLED[lang]) + _list(ADDRESSED[lang]))
    yield from ((e, STRONG) for e in _list("""you pig, you filthy rat, you scum, you loser, you losers, you coward, you piece of trash, you dick, du schwein, du sau, du ratte, du hund, du opfer, du null, du penner, du assi, du feigling, du affe, du esel, quel con, sale con, ordure va, perra de mierda, gusano de mierda, perro de mierda, rata de mierda, rata inmunda,
        porco schifoso, verme schifoso, schifoso verme, brutto porco, brutto maiale, brutta troia, brutto verme, lurido verme, lurido porco, sporca troia, pedazo de mierda, pedazo de basura, pezzo di merda, stuck dreck, stuck scheisse, sac a merde, grosse merde"""))  # fmt: skip
    for name in _list(NAMES["en"] + "," + PROFANE["en"]):
        if name not in PLAIN or name in SCORNED:
            yield f"{name} like you", STRONG
            yield f"listen {name}", STRONG
    yield from ((e, STRONG) for e in _list("""fuck you, fuck off, fuck yourself, go fuck, get fucked, fuck your, shut the fuck up, shut your mouth you, shut up you, go to hell you, eat shit, suck it bitch, kiss my ass, up your ass, screw you, bite me bitch, dumb as fuck,
        halt die fresse, halt deine fresse, halt s maul, halt dein maul, verpiss dich, verpisst euch, fick dich, fickt euch, fick deine mutter, leck mich am arsch, leck mich, friss scheisse, du kannst mich mal,
        ta gueule, ferme ta gueule, fermez vos gueules, va te faire foutre, va te faire enculer, allez vous faire foutre, nique ta mere, nique ta race, va chier, casse toi pauvre con, je t emmerde, je vous emmerde, ferme ta sale gueule, va mourir,
        vete a la mierda, vete a tomar por culo, que te jodan, que te follen, jodete, chinga tu madre, chingate, me cago en tu, la concha de tu madre, puta madre, callate la puta boca, andate a la mierda, vete al carajo, cierra el pico, tu puta madre,
        vaffanculo, fanculo, affanculo, va a cagare, vai a cagare, va a farti fottere, vai a farti fottere, fottiti, vai a quel paese stronzo, chiudi quella fogna, ma vaffa, sucamelo, porca puttana, li mortacci tua"""))  # fmt: skip
    yield from ((e, MEDIUM) for e in _list("""fuck, fucks, fucked, fucking, shut up, go to hell, piss off, bullshit, nobody likes you, everyone hates you, everybody hates you, nobody wants you here, nobody asked you, nobody wants to read this, you make me sick, you disgust me, i hate you,
        keiner will dich hier, niemand will dich hier, keiner mag dich, niemand mag dich, du widerst mich an, ich hasse dich, geh sterben, geh zum teufel, scheisse, scheiss, verfickte, verfickter, arsch,
        personne ne t aime, personne ne veut de toi, tout le monde te deteste, je te hais, tu me degoutes, va au diable, degage, casse toi, merde, foutre,
        nadie te quiere aqui, nadie te quiere, todos te odian, me das asco, te odio, largate, vete al infierno, mierda, joder, cono de tu madre, callate la boca, cierra la boca,
        qui nessuno ti vuole, nessuno ti vuole, nessuno ti sopporta, mi fai schifo, ti odio, va all inferno, vai all inferno, merda, cazzo, levati dai coglioni, levati di torno, chiudi il becco, idiota che non sei altro"""))  # fmt: skip
    yield from ((e, LIGHT) for e in _list("idiot, idiots, moron, morons, imbecile, imbeciles, cretin, cretins, bitch, bastard, prick, retard, loser, scum, shit, crap, goddamn, arse, idioten, versager, miststuck, abschaum, fresse, gueule, ordure, bouffon, idiota, idiotas, idioti, payaso, zorra, escoria, cretino, buffone, troia, feccia, culo, chatte"))


def _threats() -> Iterator[tuple[str, float]]:
    will = "i will, i ll, i am going to, i m going to, i am gonna, i m gonna, im gonna, we will, we ll, we are going to, someone should, somebody should, i want to, i would love to"
    deed = """kill you, murder you, beat you up, beat the shit out of you, break your legs, break your neck, break your arms, break your face, break every bone, smash your face, smash your head, bash your head, make you bleed, make you suffer, hunt you down, slit your throat, cut your throat,
        rape you, shoot you, stab you, strangle you, burn your house, burn you, knock your teeth out, punch you, destroy your life, hurt you, find you and, end you, bury you"""
    yield from ((e, STRONG) for e in _cross(will, deed))
    yield from ((e, STRONG) for e in _list("""kill yourself, kill yourselves, go kill yourself, kys, hang yourself, shoot yourself, drown yourself, jump off a bridge, drop dead, hope you die, hope you all die, hope you choke, hope you get cancer, hope you rot, hope you suffer, hope you burn, hope someone kills you,
        rot in hell, burn in hell, die in a fire, go die, you deserve to die, you should die, deserve to be shot, deserves to be shot, deserve to be hanged, should be shot in the head, should disappear for good, you are dead meat, better off dead, nobody would miss you, should never have been born,
        end your life, you will pay with your life, your days are numbered, put a bullet in, slit your wrists, make you bleed, break your legs, break your neck, slit your throat"""))  # fmt: skip
    yield from ((e, MEDIUM) for e in _list("i know where you live, ich weiss wo du wohnst, je sais ou tu habites, se donde vives, so dove abiti, so dove vivi, watch your back, pass bloss auf, tu vas le regretter, te vas a arrepentir, te ne pentirai, wish you were dead"))
    ich = "ich, wir, wir werden, ich werd, ich werde, ich will"
    tat = "bring dich um, bringe dich um, bringen dich um, schlag dir die zahne ein, schlage dir die zahne ein, schlag dich tot, schlage dich tot, schlag dich zusammen, brech dir, breche dir, mach dich fertig, mach dich kalt, stech dich ab, steche dich ab, dich umbringen, dich toten, dir den hals, dich erwurgen, dich vergewaltigen, dir die knochen brechen, hau dir in die fresse, polier dir die fresse, knall dich ab"
    yield from ((e, STRONG) for e in _cross(ich, tat))
    yield from ((e, STRONG) for e in _list("""bring dich um, bring dich doch um, bringt euch um, hang dich auf, erschiess dich, verrecke, verreck, verreckt, verrecken sollst, stirb endlich, krepier, krepiere, du gehorst erschossen, gehort verprugelt, gehorst verprugelt, gehort erschossen, gehort aufgehangt, an die wand gestellt, hoffe du stirbst,
        hoffentlich stirbst du, hoffentlich verreckst, wunsche dir den tod, spring von der brucke, du bist tot, kopf abschneiden, zahne einschlagen, die zahne ein"""))  # fmt: skip
    je = "je vais, on va, je veux, j aimerais, quelqu un devrait"
    acte = "te tuer, te buter, te crever, te casser la gueule, te casser les dents, te casser les jambes, te defoncer, te peter les dents, te peter la gueule, te frapper, t egorger, t etrangler, te violer, te faire saigner, te detruire, te retrouver, te planter, te saigner, vous tuer, te faire la peau"
    yield from ((e, STRONG) for e in _cross(je, acte))
    yield from ((e, STRONG) for e in _cross("creve, crevez, va crever, va mourir", "espece de, sale, gros, grosse, pauvre, putain de, ordure, charogne, connard, salope, pourriture, bande de, en enfer"))
    yield from ((e, STRONG) for e in _list("va crever, va te pendre, va te suicider, suicide toi, tue toi, pends toi, jette toi d un pont, j espere que tu vas mourir, j espere que tu vas crever, j espere que tu creves, tu merites de mourir, tu merites de crever, merite une balle, tu vas mourir salope, brule en enfer, te casser la gueule, te casser les dents"))
    voy = "te voy a, os voy a, te vamos a, voy a, quiero, deberian, alguien deberia"
    hecho = "matar, partir la cara, partir la boca, romper la cara, romper las piernas, romper los dientes, romper los huesos, reventar la cabeza, reventar, degollar, violarte, violar, matarte, hacerte sangrar, hacer sangrar, moler a palos, meter un tiro, pegar un tiro, destrozar, rajar, dar una paliza, golpearte, ahorcar"
    yield from ((e, STRONG) for e in _cross("te voy a, os voy a, te vamos a", hecho))
    yield from ((e, STRONG) for e in _cross(voy, "matarte, violarte, hacerte sangrar, golpearte, partirte la cara, romperte la cara, romperte las piernas, degollarte, reventarte"))
    yield from ((e, STRONG) for e in _list("ojala te mueras, ojala te murieras, ojala se mueran, ojala te maten, ojala te pudras, ojala revientes, muerete, muerase, matate, suicidate, ahorcate, tirate de un puente, mereces morir, mereces la muerte, pudrete en el infierno, pudrete, arde en el infierno, espero que te mueras, te mato, te matare, estas muerto cabron"))
    yield from ((e, STRONG) for e in _cross("-, adesso, io, ora", "ti ammazzo, ti uccido, ti spacco la faccia, ti spacco il culo, ti spacco la testa, ti spacco le gambe, ti rompo la faccia, ti rompo il culo, ti rompo le ossa, ti rompo le gambe, ti faccio sanguinare, ti sgozzo, ti strangolo, ti stupro, ti massacro, ti faccio a pezzi, ti taglio la gola, ti sparo, ti pesto"))
    yield from ((e, STRONG) for e in _list("""ammazzati, ucciditi, impiccati, sparati, suicidati, buttati da un ponte, devi morire, meriti di morire, meriti la morte, crepa, crepate, schiatta, spero che tu muoia, spero che tu crepi, spero che muori, spero che crepi, muori male, brucia all inferno, marcisci all inferno, vai a morire, ti ammazzero, ti uccidero,
        voglio ucciderti, voglio ammazzarti, ti veniamo a prendere"""))  # fmt: skip


def _hate() -> Iterator[tuple[str, float]]:
    # Slurs against groups.
    yield from ((e, STRONG) for e in _list("""nigger, niggers, nigga, faggot, faggots, fags, kike, kikes, spic, spics, wetback, wetbacks, chink, chinks, gook, gooks, raghead, ragheads, towelhead, towelheads, sandnigger, tranny, trannies, dyke bitch, paki, pakis, gyppo, gypsy scum, untermensch, untermenschen, subhuman, subhumans,
        kanake, kanaken, neger, nigger, schwuchtel, schwuchteln, zigeunerpack, judensau, judenschwein, kameltreiber, schlitzauge, schlitzaugen, negre, negres, bougnoule, bougnoules, bicot, youpin, youpins, pedale, tarlouze, tapette, sale arabe, sale juif, sale noir, sale pede, pedes de merde, negro de mierda, negros de mierda,
        sudaca, sudacas, moro de mierda, moros de mierda, judio de mierda, maricon, maricones, bollera de mierda, gitano de mierda, frocio, froci, ricchione, ricchioni, culattone, negro di merda, negri di merda, terrone di merda, zingaro di merda, zingari di merda, ebreo di merda, sporco negro, sporco ebreo"""))  # fmt: skip
    yield from ((e, STRONG) for e in _cross("are, are all, are nothing but, are just, are only, they are, they are all, is just another, are all just, another", "vermin, parasites, subhumans, cockroaches, human garbage, human trash, human filth, a plague on, an inferior race, savages, thieves by blood, thieves by nature, criminals by nature, born criminals, born thieves, less than human, a cancer on"))
    yield from ((e, STRONG) for e in _list("""are not people they are, are not human, are not humans, are not human beings, animals not people, just another parasite, parasite in the making, back where they came from, back where you came from, back where they crawled from, back where you crawled from, back to where you came from, back to your own country, go back to your country,
        get rid of every last one, wipe them all out, exterminate them, exterminate them all, gas them, gas them all, kill them all, gas the jews, hang them all, thieves by blood, thieves by nature, a race of thieves, inferior race, they breed like rats, breed like vermin, breed like rabbits and steal, world would be cleaner without, would be cleaner without, white power, heil hitler, race traitor,
        should be driven out like, vermin and should be"""))  # fmt: skip
    yield from ((e, MEDIUM) for e in _list("they are all thieves, they are all criminals, they are all rapists, they are all terrorists, never trust a, should all be deported, should be driven out, must be driven out, should be exterminated, must be exterminated, should be wiped out, should be gassed, world would be better without, filthy foreigners, dirty foreigners, dirty immigrants, filthy immigrants"))
    yield from ((e, STRONG) for e in _cross("sind, sind alle, sind nur, sind doch nur, sind nichts als, das sind", "ungeziefer, parasiten, abschaum, untermenschen, schmarotzer, keine menschen, diebe von blut, geborene diebe, geborene verbrecher, kakerlaken, menschlicher mull, tiere keine menschen, dreckspack, eine plage, eine minderwertige rasse"))
    yield from ((e, STRONG) for e in _list("""endlich ausrotten, alle ausrotten, ausgerottet werden mussen, gehoren vertrieben, gehoren vergast, gehoren ausgerottet, gehoren erschossen, gehoren aufgehangt, gehoren verjagt, haut ab wo ihr, geht zuruck wo ihr, wo ihr hergekommen seid, wo ihr herkommt, geh zuruck in dein land, geht zuruck in euer land, auslander raus, turken raus, juden raus,
        diebe von blut, von natur aus diebe, von natur aus kriminell, minderwertige rasse, ware sauberer ohne, sauberer ohne die, dreckige auslander, scheiss auslander, drecksauslander, kanakenpack, sieg heil"""))  # fmt: skip
    yield from ((e, STRONG) for e in _cross("sont, sont tous, ne sont que, sont juste, c est, ce sont", "de la vermine, des parasites, des cafards, des sous hommes, des sous humains, des rats, de la racaille, des voleurs de naissance, voleurs de naissance, une race inferieure, une race de voleurs, des betes pas des hommes, des dechets humains"))
    yield from ((e, STRONG) for e in _list("""ne sont pas des humains, ne sont pas des hommes, ne sont pas des etres humains, il faut les chasser, il faut les exterminer, il faut les eliminer, il faut tous les virer, il faut tous les tuer, il faut les gazer, se debarrasser de tous les, se debarrasser de tous ces, race de voleurs, race inferieure, race de chiens, retourne dans ton pays, retournez dans votre pays,
        retourne d ou tu viens, retournez d ou vous venez, rentrez dans votre pays, serait plus propre sans, sales etrangers, sales arabes, sales juifs, sales noirs, sales immigres, mort aux juifs, mort aux arabes"""))  # fmt: skip
    yield from ((e, STRONG) for e in _cross("son, son todos, son todas, son unas, no son mas que, solo son", "alimanas, parasitos, ratas, escoria, infrahumanos, subhumanos, cucarachas, basura humana, ladrones de sangre, ladrones por naturaleza, ladrones de nacimiento, una plaga, una raza inferior, una raza de ladrones, animales no personas"))
    yield from ((e, STRONG) for e in _list("""no son personas, no son humanos, no son seres humanos, hay que echarlos, hay que exterminarlos, hay que matarlos, hay que eliminarlos, hay que expulsarlos a todos, hay que acabar con todos, hay que gasearlos, ladrones de sangre, raza de ladrones, raza inferior, vuelve a tu pais, vuelvete a tu pais, vuelvan a su pais, volved a vuestro pais, vuelve por donde viniste,
        estaria mas limpio sin, sucios extranjeros, sucios inmigrantes, sucios judios, muerte a los judios, muerte a los moros, fuera los sucios, fuera los moros, fuera extranjeros"""))  # fmt: skip
    yield from ((e, STRONG) for e in _cross("sono, sono tutti, sono solo, non sono che, sono soltanto", "parassiti, feccia, subumani, scarafaggi, ratti di fogna, spazzatura umana, ladri di sangue, ladri per natura, ladri nati, una piaga, una razza inferiore, una razza di ladri, bestie non persone, vermi schifosi"))
    yield from ((e, STRONG) for e in _list("""non sono persone, non sono umani, non sono esseri umani, bisogna cacciarli, bisogna sterminarli, bisogna eliminarli, bisogna eliminare tutti, bisogna ammazzarli, vanno cacciati, vanno sterminati, vanno eliminati, vanno gasati, razza di ladri, razza inferiore, torna al tuo paese, tornate al vostro paese, torna da dove sei, tornate da dove siete, tornatene da dove,
        sarebbe piu pulito senza, sporchi stranieri, sporchi immigrati, sporchi ebrei, fuori gli sporchi, morte agli ebrei, fuori gli stranieri"""))  # fmt: skip
    yield from ((e, MEDIUM) for e in _list("dehors les, mejor sin ellos, dreckige, dreckspack, sono vermi, sono bestie, besser ohne die"))


def _sexual() -> Iterator[tuple[str, float]]:
    yield from ((e, STRONG) for e in _cross("suck, sucks, sucked, sucking, lick, licked, licking, ride, rides, riding, stroke, stroked, stroking, rub, rubbed, rubbing, touch my, touched her", "my, his, her, your, you", "cock, dick, pussy, tits, clit, balls, wet pussy, hard cock, nipples"))
    yield from ((e, STRONG) for e in _cross("hard, big, huge, thick, throbbing, wet, tight, dripping, hot, my, your, his, her, juicy", "cock, pussy, tits, boobs, cunt"))
    yield from ((e, STRONG) for e in _cross("fuck, fucked, fucks, fucking", "me, her, him, them, my, your wife, your girlfriend, all night, hard"))
    yield from ((e, STRONG) for e in _cross("horny, hot horny, naked, nude, slutty", "girls, women, wives, housewives, milfs, milf, singles, babes, chicks, sluts"))
    yield from ((e, STRONG) for e in _list("""suck you, suck you off, suck me off, spread her legs, spread your legs, take me from behind, took her from behind, bent her over, bend over for me, come inside me, cum inside, cumshot, cumshots, cumming, blowjob, blowjobs, blow job, handjob, hand job, rimjob, deepthroat, gangbang, gangbangs, threesome, creampie, bukkake, milf, milfs, dildo, buttplug, porn, porno, porn videos,
        pornhub, xxx videos, sex videos, sex tape, live sex, phone sex, hardcore sex, anal sex with, send nudes, send me nudes, nudes, naked pictures, naked pics, nude pictures, nude pics, nude photos, naked photos of you, so horny, i am horny, i m horny, am so wet, makes me wet, jerk off, jerked off, jerking off, jack off, masturbate, masturbating, masturbated, made me cum, make you cum, sit on my face, between her thighs, escort girls, sex with you tonight"""))  # fmt: skip
    yield from ((e, STRONG) for e in _list("""feuchte muschi, nasse muschi, enge muschi, ihre muschi, deine muschi, meine muschi, muschi lecken, mein schwanz, meinen schwanz, deinen schwanz, seinen schwanz, harter schwanz, harten schwanz, steifen schwanz, schwanz lutschen, schwanz blasen, einen blasen, dir einen blasen, ficken, gefickt, fick mich, ficke dich, fickt dich, durchficken, arschfick, geile frauen, geile weiber, geile schlampen, geile sau, geile hausfrauen, geile milfs,
        so geil auf dich, ich bin geil, bin so geil, mach mich geil, nacktfotos, nacktbilder, nackte frauen, titten, grosse titten, dicke titten, pralle titten, wichsen, abspritzen, sperma schlucken, pornos, pornofilme, sexfilme, telefonsex, orgie, von hinten nehmen, nimm mich von hinten, beine breit, bumsen, vogeln die ganze nacht, in den arsch"""))  # fmt: skip
    yield from ((e, STRONG) for e in _list("""te baiser, la baiser, me baiser, baise moi, baiser toute la nuit, se faire baiser, baiser comme, te sucer, me sucer, suce moi, suce ma, sucer ma bite, ma bite, ta bite, sa bite, grosse bite, bite dure, chatte mouillee, sa chatte mouillee, ta chatte, ma chatte mouillee, lecher la chatte, lecher ta chatte, gros nichons, nichons, gros seins nus, photos a poil, tes photos a poil, photos nue, photos de toi nue, photos nues, je bande, filles chaudes, femmes chaudes,
        meufs chaudes, salopes chaudes, cougars chaudes, enculer, sodomiser, branlette, te branler, me branler, se branler, fellation, en levrette, plan cul, video porno, videos porno, film porno, films porno, ejaculer, jouir dans ta, ecarte les cuisses, ecarte tes cuisses, mets toi a quatre pattes, je mouille"""))  # fmt: skip
    yield from ((e, STRONG) for e in _list("""follar, follarte, follarme, follarla, follame, follando, te follo, follamos, follada, cono mojado, tu cono, su cono mojado, mi polla, tu polla, polla dura, chupame, chuparte, chuparme, chupartela, chuparmela, chupamela, chupando la polla, comerte el cono, tetas enormes, tetas grandes, tus tetas, tetona, tetonas, estoy cachondo, estoy cachonda, muy cachondo, muy cachonda, tan cachondo, tan cachonda, chicas calientes, mujeres calientes,
        maduras calientes, fotos desnuda, fotos desnudo, fotos tuyas desnuda, fotos sin ropa, mamada, mamadas, correrme, correrte dentro, me corro, hacer una paja, hacerme una paja, video porno, videos porno, pelis porno, por el culo, metertela, metemela, abre las piernas, ponte a cuatro patas, sexo duro, coger toda la noche"""))  # fmt: skip
    yield from ((e, STRONG) for e in _list("""scoparti, scopami, scoparmi, ti scopo, voglio scopare, scopare tutta la notte, scopata, scopate, figa bagnata, la figa, la tua figa, la sua figa, figa stretta, leccare la figa, leccarti la figa, il mio cazzo, il tuo cazzo, cazzo duro, succhiami, succhiarti, succhiarmi, succhiartelo, succhiarmelo, succhiamelo, succhiare il cazzo, prendilo in bocca, tette enormi, tette grosse, le tue tette, grosse tette, foto nuda, foto nudo, foto di te nuda, foto di te nudo, tue foto nuda, ragazze calde,
        donne calde, casalinghe calde, sono eccitato, sono eccitata, molto eccitato, molto eccitata, cosi eccitato, pompino, pompini, segarmi, farmi una sega, farti una sega, inculare, inculata, sborra, sborrare, sborrata, a pecorina, video porno, film porno, allarga le gambe, apri le gambe, vengo dentro di te, ti voglio nuda"""))  # fmt: skip
    yield from ((e, LIGHT) for e in _list("cock, pussy, tits, boobs, horny, geil, geile, muschi, schwanz, a poil, polla, tetas, cachondo, cachonda, tette, figa, scopare"))


#: Harmless uses: hits that lie inside one of these don't count. Fixed values, by theme.
HARMLESS = {
    "animals and plants": """cock crowed, cock crows, cock pheasant, cock robin, rooster and cock, weather cock, cock of the walk, pussy willow, pussy willows, pussycat, blue tit, blue tits, great tits, coal tits, marsh tits, bearded tits, long tailed tits, horny toad, horny toads, horned toad, bitch and her puppies, bitch had puppies, rats are vermin, mice are vermin, foxes are vermin, moles are vermin, pigeons are vermin, rabbits are vermin,
        ratten sind ungeziefer, mause sind ungeziefer, kakerlaken sind ungeziefer, wanzen sind ungeziefer, cafards sont de la vermine, rats sont de la vermine, lombrichi sono vermi, pulci sono parassiti, zecche sono parassiti, pulgas son parasitos, garrapatas son parasitos, ratas son una plaga, langostas son una plaga, fleas are parasites, ticks are parasites, lice are parasites, mistletoe is just another parasite, zecken sind parasiten, flohe sind parasiten,
        esel und, chienne et ses chiots, la perra y sus cachorros, la cagna e i suoi cuccioli, poule et coq""",
    "medicine": "prick test, skin prick, prick of the needle, pin prick, needle prick, finger prick, breast cancer, dick test, cock up splint, fellation en latin",
    "idioms and things": """idiot proof, idiot board, tit for tat, dick and jane, moby dick, dick turpin, private dick, bastard sword, bastard file, william the bastard, cock and bull, cock up, stop cock, kill the process, ballcock, trash can, piece of trash from, garbage collector, shut up shop, shut up the shop, shut up the house, damn good, guerra di troia, cavallo di troia, citta di troia, troia fu, elena di troia, nichts als die wahrheit,
        chat et chatte, un baiser de, le baiser de, la bete humaine, sale temps, film de merde critique, porca miseria, nobel laureate dick, the fool on the hill, fools gold, april fool, april fools, con te, con el, con la, con los""",
    "reports about insults": "is hate speech, hate speech, called him an, called her a, calling them vermin, calling them parasites, the word bitch, the word nigger, the slur, the word slut, das wort hurensohn, le mot connard, la palabra puta, la parola stronzo, anti porn, porn addiction, porn ban, revenge porn law, child protection, sex education, banned porn",
}


def entries() -> dict[str, tuple[str, float]]:
    """phrase -> (category, weight); of a phrase built twice the heaviest weight counts."""
    found: dict[str, tuple[str, float]] = {}
    for category, made in (("insult", _insults()), ("threat", _threats()), ("hate", _hate()), ("sexual", _sexual())):
        for phrase, weight in made:
            if weight > found.get(phrase, ("", 0.0))[1]:
                found[phrase] = (category, weight)
    return found


def harmless() -> list[str]:
    return [e for text in HARMLESS.values() for e in _list(text)]
