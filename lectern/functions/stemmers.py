"""The published Snowball algorithms for Spanish, French, Swedish, Danish, Norwegian, Portuguese, Italian and Dutch. Words come in lower case."""

from __future__ import annotations

import re


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Where the regions after the first and the second vowel-consonant step begin."""
    find = re.compile(f"[{vowels}][^{vowels}]").search
    m = find(word)
    r1 = m.end() if m else len(word)
    m = find(word, r1)
    return r1, m.end() if m else len(word)


def _longest(word: str, suffixes: str, start: int = 0) -> str | None:
    """The longest of the suffixes that lies in the region from start."""
    found = [s for s in suffixes.split() if word.endswith(s) and len(word) - len(s) >= start]
    return max(found, key=len) if found else None


# --- Spanish ---

_ES_VOWELS = "aeiouáéíóúü"
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
_ES_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias acion"
_ES_ALL = f"{_ES_DELETE} {_ES_IC} logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos"
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
_ES_GU = "en es éis emos"
_ES_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)


def _rv_spanish(word: str) -> int:
    v = _ES_VOWELS
    if len(word) < 2:
        return len(word)
    if word[1] not in v:
        m = re.compile(f"[{v}]").search(word, 2)
        return m.end() if m else len(word)
    if word[0] in v:
        m = re.compile(f"[^{v}]").search(word, 2)
        return m.end() if m else len(word)
    return min(3, len(word))


def spanish(word: str) -> str:
    r1, r2 = _regions(word, _ES_VOWELS)
    rv = _rv_spanish(word)
    # pronouns that hang on verbs
    s = _longest(word, _ES_PRONOUNS, rv)
    if s:
        stem = word[: -len(s)]
        before = _longest(stem, "iéndo ándo ár ér ír ando iendo ar er ir yendo", rv)
        if before and (before != "yendo" or stem[: -len("yendo")].endswith("u")):
            word = stem[: -len(before)] + before.translate(_ES_PLAIN)
    was = word
    s = _longest(word, _ES_ALL)
    if s:
        at = len(word) - len(s)
        stem = word[:at]

        def gone(text: str, *endings: str) -> str:
            """text without the first of the endings that it has, if that lies in the second region."""
            for e in endings:
                if text.endswith(e):
                    return text[: -len(e)] if len(text) - len(e) >= r2 else text
            return text

        if s == "amente":
            if at >= r1:
                word = stem
                if word.endswith("iv"):
                    if len(word) - 2 >= r2:
                        word = gone(word[:-2], "at")
                else:
                    word = gone(word, "os", "ic", "ad")
        elif at >= r2:
            if s in _ES_DELETE.split():
                word = stem
            elif s in _ES_IC.split():
                word = gone(stem, "ic")
            elif s.startswith("log"):
                word = stem + "log"
            elif s.startswith("uci"):
                word = stem + "u"
            elif s.startswith("encia"):
                word = stem + "ente"
            elif s == "mente":
                word = gone(stem, "ante", "able", "ible")
            elif s.startswith("idad"):
                word = gone(stem, "abil", "ic", "iv")
            else:
                word = gone(stem, "at")
    if word == was:
        s = _longest(word, _ES_Y, rv)
        if s and word[: -len(s)].endswith("u"):
            word = word[: -len(s)]
        else:
            s = _longest(word, f"{_ES_GU} {_ES_VERB}", rv)
            if s:
                word = word[: -len(s)]
                if s in _ES_GU.split() and word.endswith("gu"):
                    word = word[:-1]
    s = _longest(word, "os a o á í ó e é", rv)
    if s:
        word = word[: -len(s)]
        if s in "eé" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ES_PLAIN)


# --- French ---

_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
_FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
_FR_ALL = (
    "ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences "
    "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
)


def french(word: str) -> str:
    v = _FR_VOWELS
    word = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
    word = re.sub(rf"(?<=[{v}])y|y(?=[{v}])", "Y", word)
    word = word.replace("qu", "qU")
    r1, r2 = _regions(word, v)
    if re.match("par|col|tap", word):
        rv = 3
    elif re.match(f"[{v}]{{2}}", word):
        rv = min(3, len(word))
    else:
        m = re.compile(f"[{v}]").search(word, 1)
        rv = m.end() if m else len(word)
    was, verb = word, True
    s = _longest(word, _FR_ALL)
    if s:
        at, stem = len(word) - len(s), word[: -len(s)]

        def inside(text: str, ending: str, region: int) -> bool:
            return text.endswith(ending) and len(text) - len(ending) >= region

        if s in ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"):
            word = stem if at >= r2 else word
        elif s.startswith(("atrice", "ateur", "ation")):
            if at >= r2:
                word = stem
                if stem.endswith("ic"):
                    word = stem[:-2] if inside(stem, "ic", r2) else stem[:-2] + "iqU"
        elif s.startswith("logie"):
            word = stem + "log" if at >= r2 else word
        elif s.startswith(("usion", "ution")):
            word = stem + "u" if at >= r2 else word
        elif s.startswith("ence"):
            word = stem + "ent" if at >= r2 else word
        elif s in ("ement", "ements"):
            if at >= rv:
                word = stem
                if word.endswith("iv"):
                    if inside(word, "iv", r2):
                        word = word[:-2]
                        word = word[:-2] if inside(word, "at", r2) else word
                elif word.endswith("eus"):
                    word = word[:-3] if inside(word, "eus", r2) else word[:-3] + "eux" if inside(word, "eus", r1) else word
                elif word.endswith(("abl", "iqU")):
                    word = word[:-3] if len(word) - 3 >= r2 else word
                elif word.endswith(("ièr", "Ièr")) and len(word) - 3 >= rv:
                    word = word[:-3] + "i"
        elif s in ("ité", "ités"):
            if at >= r2:
                word = stem
                if word.endswith("abil"):
                    word = word[:-4] if inside(word, "abil", r2) else word[:-4] + "abl"
                elif word.endswith("ic"):
                    word = word[:-2] if inside(word, "ic", r2) else word[:-2] + "iqU"
                elif inside(word, "iv", r2):
                    word = word[:-2]
        elif s in ("if", "ive", "ifs", "ives"):
            if at >= r2:
                word = stem
                if inside(word, "at", r2):
                    word = word[:-2]
                    if word.endswith("ic"):
                        word = word[:-2] if inside(word, "ic", r2) else word[:-2] + "iqU"
        elif s == "eaux":
            word = stem + "eau"
        elif s == "aux":
            word = stem + "al" if at >= r1 else word
        elif s.startswith("euse"):
            word = stem if at >= r2 else stem + "eux" if at >= r1 else word
        elif s.startswith("issement"):
            word = stem if at >= r1 and stem and stem[-1] not in v else word
        elif s in ("amment", "emment"):
            word, verb = (stem + s[0] + "nt", None) if at >= rv else (word, True)
        elif stem and stem[-1] in v and at - 1 >= rv:
            word, verb = stem, None
    changed = word != was
    if not changed or verb is None:
        before = word
        s = _longest(word, _FR_I, rv)
        if s and len(word) > len(s) and word[-len(s) - 1] not in v and len(word) - len(s) - 1 >= rv:
            word = word[: -len(s)]
        else:
            s = _longest(word, f"ions {_FR_E} {_FR_A}", rv)
            if s == "ions":
                word = word[:-4] if len(word) - 4 >= r2 else word
            elif s:
                word = word[: -len(s)]
                if s in _FR_A.split() and word.endswith("e") and len(word) - 1 >= rv:
                    word = word[:-1]
        changed = changed or word != before
    if changed:
        word = re.sub("Y$", "i", re.sub("ç$", "c", word))
    else:
        if re.search("[^aiouès]s$", word):
            word = word[:-1]
        s = _longest(word, "ion ier ière Ier Ière e", rv)
        if s == "ion":
            if len(word) - 3 >= r2 and word[-4:-3] in ("s", "t") and len(word) - 4 >= rv:
                word = word[:-3]
        elif s == "e":
            word = word[:-1]
        elif s:
            word = word[: -len(s)] + "i"
    if re.search("(enn|onn|ett|ell|eill)$", word):
        word = word[:-1]
    word = re.sub(f"[éè]([^{v}]+)$", r"e\1", word)
    return word.lower()


# --- the Scandinavian ones: one region, which leaves at least three letters ---


def _region(word: str, vowels: str) -> int:
    m = re.search(f"[{vowels}][^{vowels}]", word)
    return max(3, m.end()) if m else len(word)


def swedish(word: str) -> str:
    r1 = _region(word, "aeiouyäåö")
    s = _longest(word, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s", r1)
    if s == "s":
        if word[-2:-1] in tuple("bcdfghjklmnoprtvy"):
            word = word[:-1]
    elif s:
        word = word[: -len(s)]
    if _longest(word, "dd gd nn dt gt kt tt", r1):
        word = word[:-1]
    s = _longest(word, "lig ig els löst fullt", r1)
    if s in ("lig", "ig", "els"):
        word = word[: -len(s)]
    elif s:
        word = word[:-1]
    return word


def danish(word: str) -> str:
    v = "aeiouyæåø"
    r1 = _region(word, v)
    s = _longest(word, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s", r1)
    if s == "s":
        if word[-2:-1] in tuple("abcdfghjklmnoprtvyzå"):
            word = word[:-1]
    elif s:
        word = word[: -len(s)]

    def pair(text: str) -> str:
        return text[:-1] if _longest(text, "gd dt gt kt", r1) else text

    word = pair(word)
    if word.endswith("igst"):
        word = word[:-2]
    s = _longest(word, "ig lig elig els løst", r1)
    if s == "løst":
        word = word[:-1]
    elif s:
        word = pair(word[: -len(s)])
    if len(word) - 2 >= r1 - 1 and len(word) > r1 - 1 and re.search(r"([^" + v + r"])\1$", word) and len(word) - 1 >= r1:
        word = word[:-1]
    return word


def norwegian(word: str) -> str:
    v = "aeiouyæåø"
    r1 = _region(word, v)
    s = _longest(word, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert", r1)
    if s == "s":
        if word[-2:-1] in tuple("bcdfghjlmnoprtvyz") or re.search(f"[^{v}]ks$", word):
            word = word[:-1]
    elif s in ("erte", "ert"):
        word = word[: -len(s)] + "er"
    elif s:
        word = word[: -len(s)]
    if _longest(word, "dt vt", r1):
        word = word[:-1]
    s = _longest(word, "leg eleg ig eig lig elig els lov elov slov hetslov", r1)
    return word[: -len(s)] if s else word


# --- Portuguese ---

_PT_VOWELS = "aeiouáéíóúâêô"
_PT_DELETE = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
_PT_ALL = f"{_PT_DELETE} logia logias uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras"
_PT_VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando "
    "endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis "
    "aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos "
    "ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    v = _PT_VOWELS
    r1, r2 = _regions(word, v)
    if len(word) < 2:
        rv = len(word)
    elif word[1] not in v or word[0] in v:
        m = re.compile(f"[{v}]" if word[1] not in v else f"[^{v}]").search(word, 2)
        rv = m.end() if m else len(word)
    else:
        rv = min(3, len(word))
    was = word
    s = _longest(word, _PT_ALL)
    if s:
        at, stem = len(word) - len(s), word[: -len(s)]

        def gone(text: str, *endings: str) -> str:
            for e in endings:
                if text.endswith(e):
                    return text[: -len(e)] if len(text) - len(e) >= r2 else text
            return text

        if s in ("ira", "iras"):
            word = stem + "ir" if at >= rv and stem.endswith("e") else word
        elif s == "amente":
            if at >= r1:
                word = stem
                if word.endswith("iv"):
                    word = gone(word[:-2], "at") if len(word) - 2 >= r2 else word
                else:
                    word = gone(word, "os", "ic", "ad")
        elif at >= r2:
            if s in _PT_DELETE.split():
                word = stem
            elif s.startswith("logia"):
                word = stem + "log"
            elif s.startswith("uç"):
                word = stem + "u"
            elif s.startswith("ência"):
                word = stem + "ente"
            elif s == "mente":
                word = gone(stem, "ante", "avel", "ível")
            elif s.startswith("idade"):
                word = gone(stem, "abil", "ic", "iv")
            else:
                word = gone(stem, "at")
    if word == was:
        s = _longest(word, _PT_VERB, rv)
        word = word[: -len(s)] if s else word
    if word != was:
        if word.endswith("ci") and len(word) - 1 >= rv:
            word = word[:-1]
    else:
        s = _longest(word, "os a i o á í ó", rv)
        word = word[: -len(s)] if s else word
    if word[-1:] in tuple("eéê") and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


# --- Italian ---

_IT_VOWELS = "aeiouàèìòù"
_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
_IT_DELETE = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"
_IT_ALL = f"{_IT_DELETE} azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive"
_IT_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete "
    "erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero "
    "ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    v = _IT_VOWELS
    word = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    word = re.sub(rf"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
    r1, r2 = _regions(word, v)
    if len(word) < 2:
        rv = len(word)
    elif word[1] not in v or word[0] in v:
        m = re.compile(f"[{v}]" if word[1] not in v else f"[^{v}]").search(word, 2)
        rv = m.end() if m else len(word)
    else:
        rv = min(3, len(word))
    s = _longest(word, _IT_PRONOUNS, rv)
    if s:
        stem = word[: -len(s)]
        if _longest(stem, "ando endo", rv):
            word = stem
        elif _longest(stem, "ar er ir", rv):
            word = stem + "e"
    was = word
    s = _longest(word, _IT_ALL)
    if s:
        at, stem = len(word) - len(s), word[: -len(s)]

        def gone(text: str, *endings: str) -> str:
            for e in endings:
                if text.endswith(e):
                    return text[: -len(e)] if len(text) - len(e) >= r2 else text
            return text

        if s == "amente":
            if at >= r1:
                word = stem
                if word.endswith("iv"):
                    word = gone(word[:-2], "at") if len(word) - 2 >= r2 else word
                else:
                    word = gone(word, "os", "ic", "abil")
        elif s in ("amento", "amenti", "imento", "imenti"):
            word = stem if at >= rv else word
        elif at >= r2:
            if s in _IT_DELETE.split():
                word = stem
            elif s.startswith(("azion", "ator")):
                word = gone(stem, "ic")
            elif s.startswith("logi"):
                word = stem + "log"
            elif s.startswith(("uzion", "usion")):
                word = stem + "u"
            elif s.startswith("enz"):
                word = stem + "ente"
            elif s == "ità":
                word = gone(stem, "abil", "ic", "iv")
            else:
                cut = gone(stem, "at")
                word = gone(cut, "ic") if cut != stem else cut
    if word == was:
        s = _longest(word, _IT_VERB, rv)
        word = word[: -len(s)] if s else word
    if word[-1:] in tuple("aeioàèìò") and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith("i") and len(word) - 1 >= rv:
            word = word[:-1]
    if word.endswith(("ch", "gh")) and len(word) - 2 >= rv:
        word = word[:-1]
    return word.lower()


# --- Dutch ---

_NL_VOWELS = "aeiouyè"
_NL_PLAIN = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def dutch(word: str) -> str:
    v = _NL_VOWELS
    word = word.translate(_NL_PLAIN)
    word = re.sub(rf"^y|(?<=[{v}])y", "Y", word)
    word = re.sub(rf"(?<=[{v}])i(?=[{v}])", "I", word)
    r1, r2 = _regions(word, v)
    r1 = max(3, r1)

    def undoubled(text: str) -> str:
        return text[:-1] if text.endswith(("kk", "dd", "tt")) else text

    def without_en(text: str, ending: str) -> str:
        stem = text[: -len(ending)]
        if len(stem) >= r1 and stem and stem[-1] not in v and not stem.endswith("gem"):
            return undoubled(stem)
        return text

    def without_e(text: str) -> str:
        if text.endswith("e") and len(text) - 1 >= r1 and text[-2:-1] and text[-2] not in v:
            return undoubled(text[:-1])
        return text

    s = _longest(word, "heden en ene s se")
    if s == "heden":
        word = word[:-5] + "heid" if len(word) - 5 >= r1 else word
    elif s in ("en", "ene"):
        word = without_en(word, s)
    elif s:
        stem = word[: -len(s)]
        if len(stem) >= r1 and stem and stem[-1] not in v + "j":
            word = stem
    before = word
    word = without_e(word)
    removed = word != before
    if word.endswith("heid") and len(word) - 4 >= r2 and word[-5:-4] != "c":
        word = word[:-4]
        if word.endswith("en"):
            word = without_en(word, "en")
    s = _longest(word, "end ing ig lijk baar bar", r2)
    if s in ("end", "ing"):
        word = word[:-3]
        if word.endswith("ig") and len(word) - 2 >= r2 and word[-3:-2] != "e":
            word = word[:-2]
        else:
            word = undoubled(word)
    elif s == "ig":
        word = word[:-2] if word[-3:-2] != "e" else word
    elif s == "lijk":
        word = without_e(word[:-4])
    elif s == "baar" or s == "bar" and removed:
        word = word[: -len(s)]
    if re.search(rf"[^{v}](aa|ee|oo|uu)[^{v}I]$", word):
        word = word[:-2] + word[-1]
    return word.lower()
