"""The language of short texts, by profiles of letter sequences.

A naive Bayes model over the letter sequences (one to four letters, word borders included) of each
word, trained on a sample text and the frequent words of each language; a text's score is the sum
over its words. Words are scored once per process, so a text costs a look-up a word.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

#: Sample texts, one per language.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. When two threads write the same value, one of the changes is lost; that is why we moved the lock and added a test which shows how the service behaves after a restart. Could you explain what would happen if the list were empty, and whether we should remove the check before the next release? The function returns nothing because its result has never been stored anywhere, so every call computes it again.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Wenn zwei Prozesse gleichzeitig denselben Wert schreiben, geht eine der Änderungen verloren; deshalb haben wir die Sperre verschoben und einen Test ergänzt, der zeigt, wie sich der Dienst nach einem Neustart verhält. Kannst du erklären, was passiert, wenn die Liste leer ist, und ob wir die Prüfung vor der nächsten Veröffentlichung entfernen sollten? Die Funktion gibt nichts zurück, weil ihr Ergebnis nirgends gespeichert wurde.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Si dos procesos escriben el mismo valor a la vez, uno de los cambios se pierde; por eso hemos movido el bloqueo y añadido una prueba que muestra cómo se comporta el servicio después de reiniciarlo. ¿Puedes explicar qué ocurriría si la lista estuviera vacía y si deberíamos quitar la comprobación antes de la próxima versión? La función no devuelve nada porque su resultado nunca se ha guardado en ningún sitio.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Lorsque deux processus écrivent la même valeur en même temps, une des modifications est perdue ; c'est pourquoi nous avons déplacé le verrou et ajouté un test qui montre comment le service se comporte après un redémarrage. Peux-tu expliquer ce qui se passerait si la liste était vide et s'il faut retirer la vérification avant la prochaine version ? La fonction ne renvoie rien car son résultat n'a jamais été gardé.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Quando due processi scrivono lo stesso valore nello stesso momento, una delle modifiche va perduta; perciò abbiamo spostato il blocco e aggiunto una prova che mostra come si comporta il servizio dopo un riavvio. Puoi spiegare che cosa succederebbe se la lista fosse vuota e se dovremmo togliere il controllo prima della prossima versione? La funzione non restituisce nulla perché il suo risultato non è mai stato salvato.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Quando dois processos escrevem o mesmo valor ao mesmo tempo, uma das alterações é perdida; por isso movemos o bloqueio e acrescentamos um teste que mostra como o serviço se comporta depois de ser reiniciado. Pode explicar o que aconteceria se a lista estivesse vazia e se deveríamos retirar a verificação antes da próxima versão? A função não devolve nada porque o seu resultado nunca foi guardado em lugar nenhum.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Wanneer twee processen tegelijk dezelfde waarde schrijven, gaat een van de wijzigingen verloren; daarom hebben we het slot verplaatst en een test toegevoegd die laat zien hoe de dienst zich na een herstart gedraagt. Kun je uitleggen wat er zou gebeuren als de lijst leeg was, en of we de controle voor de volgende versie moeten weghalen? De functie geeft niets terug omdat het resultaat nergens is bewaard.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Gdy dwa procesy zapisują tę samą wartość jednocześnie, jedna ze zmian zostaje utracona; dlatego przenieśliśmy blokadę i dodaliśmy test, który pokazuje, jak usługa zachowuje się po ponownym uruchomieniu. Czy możesz wyjaśnić, co by się stało, gdyby lista była pusta, i czy powinniśmy usunąć sprawdzenie przed następnym wydaniem? Funkcja niczego nie zwraca, ponieważ jej wynik nigdy nie został zapisany.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. När två processer skriver samma värde samtidigt går en av ändringarna förlorad; därför har vi flyttat låset och lagt till ett test som visar hur tjänsten beter sig efter en omstart. Kan du förklara vad som skulle hända om listan var tom, och om vi borde ta bort kontrollen före nästa version? Funktionen returnerar ingenting eftersom resultatet aldrig har sparats någonstans.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Když dva procesy zapisují stejnou hodnotu současně, jedna ze změn se ztratí; proto jsme přesunuli zámek a přidali test, který ukazuje, jak se služba chová po restartu. Můžete vysvětlit, co by se stalo, kdyby byl seznam prázdný, a zda bychom měli kontrolu před příštím vydáním odstranit? Funkce nic nevrací, protože její výsledek nebyl nikdy nikde uložen.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. İki süreç aynı anda aynı değeri yazarsa değişikliklerden biri kaybolur; bu yüzden kilidi taşıdık ve hizmetin yeniden başlatıldıktan sonra nasıl davrandığını gösteren bir test ekledik. Liste boş olsaydı ne olurdu ve bir sonraki sürümden önce denetimi kaldırmalı mıyız, açıklayabilir misin? İşlev hiçbir şey döndürmüyor çünkü sonucu hiçbir yerde saklanmadı.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Când două procese scriu aceeași valoare în același timp, una dintre modificări se pierde; de aceea am mutat blocajul și am adăugat un test care arată cum se comportă serviciul după repornire. Poți explica ce s-ar întâmpla dacă lista ar fi goală și dacă ar trebui să scoatem verificarea înainte de următoarea versiune? Funcția nu întoarce nimic deoarece rezultatul ei nu a fost păstrat niciodată.",
}
#: Frequent words, beside the samples.
FREQUENT = {
    "it": "il lo la i gli le un una uno di del della dei delle a al alla da dal in nel nella con su per tra e o ma non che chi cui se come quando perché più già anche ancora questo questa quello è sono sei era ha hanno ho abbiamo essere si ci ne mi ti".split(),
    "pt": "o a os as um uma de do da dos das em no na nos nas com por para e ou mas não que quem se como quando porque mais já também ainda este esta isso isto ele ela eles elas é são foi era tem têm está estão ser ao à pelo pela".split(),
    "nl": "de het een en of maar niet geen van in op aan met voor door uit bij naar om te dat die dit deze er is zijn was waren wordt worden heeft hebben kan moet zal ook nog al als wanneer omdat ik je we wij ze zij hij hun".split(),
    "pl": "i w na z do nie że się jest są był była to ten ta te tego tej o od po za przez przy dla jak kiedy gdy ponieważ ale lub oraz już jeszcze tylko może można który która które ja my oni jego jej ich".split(),
    "sv": "och i att det som en ett på är av för med den till inte om har de vi du jag han hon men så kan ska när eftersom från vid eller också var bara".split(),
    "cs": "a v na se z do že je jsou byl byla to ten ta ty o od po za při pro jak když protože ale nebo už ještě jen může který která které já my oni jeho její jejich není".split(),
    "tr": "ve bir bu da de için ile ne ki değil var yok olan olarak daha çok gibi ama veya çünkü ya mi mı ben sen biz siz o onlar kadar sonra önce her".split(),
    "ro": "și în la de cu pe un o nu că se este sunt era a al ale din pentru prin ca când dacă mai dar sau care ce el ea ei ele le i-a am ai au fi acest această".split(),
}
LANGUAGES = tuple(SAMPLES)
_SMOOTH = 0.4
_KEEP = 200_000


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[k : k + n] for n in (2, 3, 4) for k in range(len(w) - n + 1)] + list(word)


class Profiles:
    """Scores of words, one number per language, trained on sample texts and frequent words."""

    def __init__(self, samples: dict[str, str], frequent: dict[str, list[str]], split) -> None:
        counts = {}
        for lang, text in samples.items():
            c: Counter = Counter()
            for w in [*split(text), *frequent.get(lang, ())]:
                c.update(_grams(w.lower()))
            counts[lang] = c
        kinds = len(set().union(*counts.values()))
        self.grams: dict[str, np.ndarray] = {}
        totals = {lang: sum(c.values()) + _SMOOTH * kinds for lang, c in counts.items()}
        for g in set().union(*counts.values()):
            row = np.array([math.log((counts[lang][g] + _SMOOTH) / totals[lang]) for lang in samples])
            self.grams[g] = row - row.mean()
        self.rest = np.zeros(len(samples))
        self.words: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        """How much a word speaks for each language, more or less than for the mean of all."""
        found = self.words.get(w)
        if found is None:
            rows = [self.grams[g] for g in _grams(w) if g in self.grams]
            found = np.sum(rows, axis=0) / math.sqrt(len(rows)) if rows else self.rest
            if len(self.words) >= _KEEP:
                self.words.clear()
            self.words[w] = found
        return found

    def score(self, words: list[str]) -> np.ndarray:
        return np.sum([self.word(w) for w in words], axis=0) if words else self.rest
