"""A grammar of refusals over classes of words, language by language.

A sentence declines if it derives from one of these rules (X .. Y: in this order, within reach):

    inability   subject .. negated modal .. act         "we are not able to .. comment"
                impersonal negation .. act              "no answer can be given", "cannot help"
    decline     subject .. verb of declining            "I will have to pass on", "je m'abstiens"
    beyond      request .. predicate of being beyond    "that falls outside my remit"
    bar         norm .. verb of barring                 "our guidelines rule this out"
    lack        negation .. have .. authority           "I lack the clearance"
    leave       subject .. leave .. to others           "I'll leave this one to the maintainers"

The classes are word lists per language, the rules are the same for all languages. Verbs of finding
("I cannot reproduce it") take the place of the act and make a finding of it, no refusal.
"""

from __future__ import annotations

import re
from functools import lru_cache

_ELISION = re.compile(r"(?:[jnmtlsdc]|qu)'")
_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")

#: Classes of words by language; a star stands for any ending, an underscore for a space.
CLASSES: dict[str, dict[str, str]] = {
    "en": {
        "self": "i i'm i'd i'll i've we we're we'd we'll we've me us myself ourselves assistant bot reviewer model system tool service",
        "not": "not never no neither nor unable can't cannot couldn't won't wouldn't don't doesn't isn't aren't shouldn't mustn't ain't",
        "modal": "can could may might must will would shall should able unable can't cannot couldn't won't wouldn't shouldn't mustn't allowed permitted authorised authorized entitled willing going position supposed free qualified comfortable possible impossible way prepared equipped cleared inclined meant place appropriate proper right ethical responsible suitable acceptable told instructed asked ordered advised",
        "act": "help helping assist assisting assistance answer answering answers respond responding response reply replying comment commenting comments review reviewing discuss discussing advise advising advice opinion opinions weigh provide providing share sharing offer offering give giving say saying opine process processing handle handling address addressing engage engaging speak speaking talk talking speculate disclose reveal continue proceed comply fulfil fulfill complete support supporting evaluate evaluating assess assessing judge analyse analyze explain summarise summarize recommend suggest assistance guidance feedback view verdict statement tackle entertain take touch look approve sign go do guess answered handled supported discussed reviewed addressed provided given offered made",
        "find": "reproduce find see spot detect locate confirm verify think imagine recommend_enough tell remember recall understand",
        "decline": "decline declining refuse refusing abstain abstaining refrain refraining pass passing skip skipping withhold sit bow recuse steer opt shy",
        "request": "request requests question questions topic topics matter matters inquiry inquiries query this that it these those such task tasks subject issue point one anything something",
        "beyond": "outside beyond off-limits off scope bounds remit purview above grade restricted prohibited forbidden confidential classified competence competency jurisdiction mandate mine elsewhere",
        "norm": "policy policies guideline guidelines rule rules instructions terms permissions configuration settings compliance law agreement",
        "bar": "forbid forbids forbidden prohibit prohibits prohibited prevent prevents stop stops keep keeps bar bars barred rule rules block blocks disallow disallows restrict restricts against violate violates violating breach contravene permit permits allow allows let lets prohibits",
        "have": "have has had lack lacks having",
        "authority": "permission permissions authority authorisation authorization clearance right rights mandate competence standing expertise liberty",
        "leave": "leave leaving hand handing defer deferring refer referring redirect redirecting rather prefer best better",
        "others": "others someone else somebody human humans maintainer maintainers team owner owners colleague colleagues expert experts person people unanswered out alone",
        "regret": "sorry apologies apologise apologize afraid unfortunately regrettably regret sadly alas",
    },
    "de": {
        "self": "ich wir mir uns mich assistent bot",
        "not": "nicht kein keine keinen keiner keinem keinerlei nie niemals weder leider ungern",
        "modal": "kann könnte können darf dürfen werde werden will wollen möchte möchten soll sollte muss müssen vermag imstande lage befugt berechtigt autorisiert erlaubt gestattet möglich zuständig bereit",
        "act": "helfen weiterhelfen antworten beantworten kommentieren sagen äußern auskunft auskünfte stellung bewerten beurteilen prüfen begutachten unterstützen eingehen bearbeiten rat ratschläge ratschlag geben behandeln besprechen diskutieren erteilen empfehlung empfehlungen einschätzung meinung antwort hilfe dienen übernehmen stellungnahme befassen nachkommen urteilen urteil entsprechen beantworte kommentiere bespreche behandle diskutiere prüfe bewerte",
        "find": "reproduzieren finden feststellen erkennen sehen nachvollziehen bestätigen entdecken",
        "decline": "ablehnen lehne ablehne verweigere verweigern verzichte enthalte enthalten absehen sehe_davon weigere zurückweisen passe",
        "request": "anfrage anfragen frage fragen anliegen thema themen bitte aufgabe dies das diese dieser dazu dabei hierzu hierbei darüber damit daran darauf solche derartige sache",
        "beyond": "außerhalb jenseits tabu zuständigkeit zuständigkeitsbereich aufgabenbereich befugnisse kompetenz kompetenzen hinaus vertraulich gesperrt",
        "norm": "richtlinie richtlinien vorgaben vorgabe regeln regel regelwerk bestimmungen vorschriften policy anweisungen",
        "bar": "verbieten verbietet untersagen untersagt verhindern verhindert hindern hindert erlauben erlaubt lassen zulassen gestatten gestattet ausschließen schließen schließt",
        "have": "habe haben fehlt fehlen besitze",
        "authority": "berechtigung befugnis erlaubnis genehmigung freigabe recht kompetenz",
        "leave": "überlasse überlassen lieber verweise weitergeben",
        "others": "anderen jemand maintainer team verantwortlichen kollegen menschen entwickler offen",
        "regret": "leider bedaure bedauerlicherweise leid entschuldigung",
    },
    "es": {
        "self": "yo me mí nos nosotros puedo podemos podré debo debemos estoy tengo tenemos soy asistente bot voy prefiero quiero pretendo puedo",
        "not": "no ni nunca tampoco ningún ninguna jamás imposible",
        "modal": "puedo podemos podré podría debo debemos voy quiero deseo permitido permite permiten autorizado autorizada posible capacitado capacitada habilitado habilitada condiciones corresponde compete puede imposible",
        "act": "ayudar ayudarte ayudarle ayudaros responder responderte contestar comentar opinar revisar dar darte darle ofrecer atender hablar proporcionar asistir analizar evaluar pronunciarme compartir tratar opinión respuesta ayuda consejo consejos decir recomendar aconsejar valorar juzgar hacerlo seguir continuar entrar",
        "find": "encontrar encuentro reproducir ver veo confirmar detectar detecto",
        "decline": "rechazar rechazo declinar declino abstenerme abstengo negarme niego renuncio excusarme paso abstenernos",
        "request": "pregunta preguntas petición peticiones solicitud solicitudes consulta consultas tema temas esto eso ello asunto este esta estas esas tales cuestión",
        "beyond": "fuera ámbito alcance competencia competencias confidencial restringido restringida excede sobrepasa ajeno vetado",
        "norm": "política políticas normas norma directrices reglas instrucciones condiciones reglamento",
        "bar": "impide impiden prohíbe prohíben permite permiten vetan excluyen dejan",
        "have": "tengo tenemos carezco dispongo",
        "authority": "permiso permisos autorización autoridad derecho competencia facultad",
        "leave": "dejo dejaré prefiero remito cedo",
        "others": "otros otra alguien humano equipo responsables mantenedores persona",
        "regret": "lamento siento lamentablemente desgraciadamente desafortunadamente disculpa perdón",
    },
    "fr": {
        "self": "je j nous me moi m assistant bot",
        "not": "ne n pas aucune aucun jamais ni impossible",
        "modal": "peux peut pouvons pourrai pourrais dois devons souhaite veux vais suis sommes mesure autorisé autorisée habilité habilitée permis possible capable position impossible compte",
        "act": "aider répondre commenter donner examiner traiter discuter fournir évaluer prononcer assister accéder parler réponse avis aide conseil conseils conseiller juger analyser dire relire revoir partager proposer recommander poursuivre continuer aborder accompagner",
        "find": "trouver trouve reproduire voir vois confirmer constater détecter",
        "decline": "refuser refuse décliner décline abstenir abstiens abstient renonce passe récuse",
        "request": "demande demandes question questions requête requêtes sujet sujets cela ça ceci ce cette ces telles point",
        "beyond": "hors dehors dépasse dépassent cadre périmètre ressort compétence compétences confidentiel relève relèvent interdit domaine",
        "norm": "règles règle directives directive politique consignes consigne règlement conditions instructions",
        "bar": "interdisent interdit empêchent empêche permettent permet autorisent autorise excluent proscrivent",
        "have": "ai avons dispose manque",
        "authority": "autorisation permission droit compétence habilitation",
        "leave": "laisse laisserai préfère renvoie confie",
        "others": "autres autre quelqu équipe humain responsables mainteneurs personne",
        "regret": "désolé désolée regrette regret malheureusement hélas navré navrée",
    },
    "it": {
        "self": "io posso possiamo devo dobbiamo sono siamo mi ci ho abbiamo assistente potrò intendo preferisco", "not": "non nessuna nessun né impossibile",
        "modal": "posso possiamo potrò devo dobbiamo grado autorizzato autorizzata permesso possibile abilitato consentito può impossibile intendo", "act": "aiutare aiutarti aiutarla rispondere risponderti commentare dare fornire esprimere esprimermi parlare discutere valutare aiuto risposta opinione consiglio consigli consigliare revisionare analizzare trattare assistere dire",
        "find": "trovare trovo riprodurre vedere vedo confermare", "decline": "rifiutare rifiuto declinare declino astenermi astengo rinuncio", "request": "richiesta richieste domanda domande argomento argomenti questo questa ciò tema questione",
        "beyond": "fuori ambito oltre competenza competenze esula riservato", "norm": "regole regola politica politiche linee direttive istruzioni", "bar": "vietano vieta impediscono impedisce consentono consente permettono permette", "have": "ho abbiamo dispongo", "authority": "autorizzazione permesso diritto",
        "leave": "lascio preferisco rimando", "others": "altri qualcun team umano responsabili", "regret": "spiacente dispiace purtroppo scusa",
    },
    "pt": {
        "self": "eu posso podemos devo devemos estou sou me nos tenho temos assistente vou prefiro poderei", "not": "não nem nunca nenhuma nenhum impossível",
        "modal": "posso podemos poderei devo devemos autorizado autorizada permitido possível capaz condições habilitado vou pode impossível", "act": "ajudar ajudá-lo responder comentar dar fornecer opinar falar discutir avaliar ajuda resposta opinião conselho conselhos aconselhar revisar analisar tratar dizer partilhar compartilhar oferecer",
        "find": "encontrar encontro reproduzir ver vejo confirmar", "decline": "recusar recuso declinar declino abster abster-me abstenho", "request": "pedido pedidos pergunta perguntas tema assunto assuntos isto isso este esta questão solicitação",
        "beyond": "fora âmbito escopo além competência confidencial restrito", "norm": "regras regra política políticas diretrizes normas instruções", "bar": "proíbem proíbe impedem impede permitem permite", "have": "tenho temos disponho", "authority": "autorização permissão direito",
        "leave": "deixo prefiro remeto", "others": "outros alguém equipa equipe humano responsáveis", "regret": "lamento infelizmente desculpe sinto",
    },
    "nl": {
        "self": "ik wij we mij me ons assistent bot", "not": "niet geen nooit noch helaas", "modal": "kan kunnen mag mogen zal wil willen moet moeten staat bevoegd gemachtigd toegestaan mogelijk bereid", "act": "helpen antwoorden beantwoorden reageren geven zeggen beoordelen bespreken adviseren advies mening antwoord hulp behandelen uitspreken ondersteunen commentaar ingaan",
        "find": "vinden reproduceren zien bevestigen", "decline": "weiger weigeren afwijzen onthoud onthouden bedank sla", "request": "verzoek verzoeken vraag vragen onderwerp dit dat deze hierop hierover daarover hiermee", "beyond": "buiten bevoegdheid bereik vertrouwelijk taken",
        "norm": "regels beleid richtlijnen voorschriften", "bar": "verbieden verbiedt verhinderen toestaan staan laten", "have": "heb hebben", "authority": "toestemming bevoegdheid recht", "leave": "laat liever verwijs", "others": "anderen iemand team mens beheerders over", "regret": "helaas sorry spijt",
    },
    "pl": {
        "self": "ja mogę możemy muszę mam mamy jestem nam mnie mi asystent wolę", "not": "nie żadnej żadnych nigdy niestety", "modal": "mogę możemy wolno powinienem jestem stanie upoważniony uprawniony można możliwe", "act": "pomóc odpowiedzieć odpowiadać komentować udzielić udzielać doradzić doradzać ocenić oceniać powiedzieć omówić wypowiadać odpowiedzi porady pomocy opinii zająć",
        "find": "znaleźć odtworzyć widzę potwierdzić", "decline": "odmawiam odmówić odrzucam powstrzymam wstrzymuję", "request": "prośba prośby prośbę pytanie pytania temat to tę tym tego sprawa sprawie", "beyond": "poza zakresem zakres wykracza kompetencje poufne",
        "norm": "zasady regulamin polityka wytyczne", "bar": "zabraniają zabrania zakazują pozwalają pozwala", "have": "mam mamy", "authority": "upoważnienia uprawnień zgody prawa", "leave": "zostawiam pozostawiam wolę", "others": "innym komuś zespołowi zespół", "regret": "przepraszam niestety przykro",
    },
}
_LEXICON: dict[str, dict[str, frozenset[str]]] = {lang: {name: frozenset(w.replace("_", " ") for w in text.split()) for name, text in classes.items()} for lang, classes in CLASSES.items()}
_HINTS_OF = {lang: frozenset(w for n in ("not", "decline", "beyond", "regret", "leave", "bar", "have") for w in c[n]) for lang, c in _LEXICON.items()}
_HINTS = frozenset().union(*_HINTS_OF.values())
#: Impersonal phrases that are a refusal by themselves, with the sentence's other words free.
_SET_PHRASES = re.compile(r"\bno comment\b|\b(?:above|beyond|over) my pay (?:grade|scale)\b|\bnot (?:for me|my (?:call|place|job|business)|mine) to\b|\bstay(?:ing)? (?:out of|away from|clear of)\b|\bsteer(?:ing)? clear\b|\bsit(?:ting)? (?:this|that|it|these) (?:one )?out\b|\b(?:bow|opt)(?:ing)? out\b|\brather not\b|\bprefer not\b", re.I)


#: Acts that are done to code as well; they count only beside a word for the request.
_WEAK = frozenset(
    "handle handling process processing take touch look give giving provide providing share sharing offer offering go do support supporting continue proceed complete evaluate evaluating assess assessing judge approve sign address addressing say saying explain summarise summarize view statement "
    "sagen geben prüfen bearbeiten behandeln unterstützen übernehmen bewerten dienen dar ofrecer analizar evaluar tratar decir hacerlo seguir continuar compartir revisar donner examiner traiter évaluer dire fournir analyser poursuivre continuer relire revoir dare fornire dire trattare analizzare dar fornecer analisar tratar dizer geven zeggen behandelen ocenić powiedzieć omówić".split()
)
#: Nouns for what was asked.
_TOPICS = frozenset("request requests question questions topic topics inquiry inquiries queries anfrage anfragen frage fragen anliegen themen pregunta preguntas petición peticiones solicitud solicitudes consulta consultas temas demande demandes question questions requête requêtes sujets richiesta richieste domanda domande pedido pedidos pergunta perguntas verzoek verzoeken vraag vragen pytania prośby".split())
#: What goes against a norm.
_AGAINST = frozenset("against violate violates violating breach contravene".split())
#: Words that say whose remit it is.
_OWN = frozenset("my our mein meine meiner meinem meinen unserer mi mis mon ma mes notre mio mia mie meu minha mijn moje moich moim off-limits limits tabu vetado".split())
#: Verbs that bar only when negated.
_ALLOW = frozenset("permit permits allow allows let lets erlauben erlaubt lassen zulassen gestatten gestattet permite permiten dejan permettent permet autorisent autorise consentono consente permettono permette permitem toestaan staan laten pozwalają pozwala".split())


@lru_cache(maxsize=200_000)
def _classes(word: str, lang: str) -> frozenset[str]:
    return frozenset(name for name, words in _LEXICON[lang].items() if word in words)


def _near(marks: list[frozenset[str]], first: str, second: str, reach: int) -> bool:
    """A word of class ``first`` and after it, at most ``reach`` words on, one of class ``second``."""
    last = -1
    for k, m in enumerate(marks):
        if second in m and last >= 0 and k - last <= reach and k != last:
            return True
        if first in m:
            last = k
    return False


def _declines_in(words: list[str], lang: str) -> bool:
    marks = [_classes(w, lang) for w in words]
    here = frozenset().union(*marks) if marks else frozenset()
    if "not" not in here and not here & {"decline", "beyond", "leave", "have", "regret", "bar"}:
        return False
    at = {c: [k for k, m in enumerate(marks) if c in m] for c in here}
    subject = at.get("self", [])
    negated = at.get("not", [])
    # inability: subject .. (negation, modal in any order, close) .. act; a verb of finding before the act makes it a finding
    for n in negated:
        modal = [m for m in at.get("modal", []) if abs(m - n) <= 6]
        if not modal:
            continue
        first = min(n, *modal)
        spoken = any(s - 6 <= n and s <= max(modal) + 4 for s in subject) or all("regret" in marks[k] for k in range(first)) or lang in ("es", "it", "pt", "pl") and bool(subject)
        acts = [a for a in at.get("act", []) if first - 6 <= a <= max(n, *modal) + 10 and a not in modal and (words[a] not in _WEAK or any(abs(r - a) <= 6 for r in at.get("request", [])))]
        found = [f for f in at.get("find", []) if f > first]
        if spoken and acts and not (found and min(found) <= min(acts)):
            return True
    declined = [d for d in at.get("decline", []) if not any(0 < d - n <= 3 and "regret" not in marks[n] for n in negated)]
    if any(0 < d - s <= 7 or lang in ("de", "nl") and 0 < s - d <= 3 for s in subject for d in declined) or declined[:1] in ([0], [1]):
        if here & {"act", "request", "regret", "others"}:
            return True
    if any(0 < v - s <= 3 for s in subject for v in at.get("leave", [])) and _near(marks, "leave", "not", 3) and _near(marks, "not", "act", 4) or lang in ("es", "it", "pt", "pl") and _near(marks, "leave", "not", 2) and _near(marks, "not", "act", 3):
        return True
    if "beyond" in here and _near(marks, "request", "beyond", 9):
        mine = any(0 < s - b <= 4 and any(0 < m - s <= 5 for c in ("modal", "act") for m in at.get(c, [])) for b in at["beyond"] for s in subject)
        if mine or not _OWN.isdisjoint(words):
            return True
    if "norm" in here and "bar" in here:
        for b in at["bar"]:
            barred = any(0 < x - b <= 7 and (c == "request" or words[x] not in _WEAK) for c in ("request", "act") for x in at.get(c, []))
            if words[b] in _AGAINST and any(0 < n - b <= 5 for n in at["norm"]) and "request" in here:
                return True
            if words[b] not in _AGAINST and any(0 < b - n <= 5 for n in at["norm"]) and barred and (words[b] not in _ALLOW or negated):
                return True
    if _TOPICS & set(words) and any(0 < n - t <= 9 and any(0 < x - n <= 2 for x in at.get("act", [])) for n in negated for t, w in enumerate(words) if w in _TOPICS):
        return True  # such questions are not answered here
    if subject and any(0 < a - t <= 5 and any(0 < n - a <= 5 for n in negated) for t, w in enumerate(words) if w in _TOPICS for a in at.get("act", [])):
        return True  # such questions I answer never
    if "have" in here and "authority" in here and ("not" in here or {"lack", "lacks", "fehlt", "fehlen", "carezco", "manque"} & set(words)) and _near(marks, "have", "authority", 6):
        return True
    if "leave" in here and "others" in here and subject and _near(marks, "leave", "others", 8) and any(0 < v - s <= 5 for s in subject for v in at["leave"]) and here & {"request", "act", "regret"}:
        return True
    return False


def declines(sentence: str) -> bool:
    """Whether a sentence declines to answer, in any of the languages of the grammar."""
    low = sentence.lower().replace("’", "'")
    if _SET_PHRASES.search(low):
        return True
    words = _TOKEN.findall(low)
    words = [p for w in words for p in (w.split("'") if "'" in w and _ELISION.match(w) else [w])]
    if _HINTS.isdisjoint(words):
        return False
    return any(_declines_in(words, lang) for lang in CLASSES if not _HINTS_OF[lang].isdisjoint(words))
