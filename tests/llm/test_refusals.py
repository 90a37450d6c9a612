"""Refusals, truncation and languages on phrasings that were written after the grammar and aren't in it."""

import pytest

from tallyloom.llm.textcheck import is_refusal, is_truncated, is_wrong_language, language

REFUSALS = """
That's above my pay grade; ask a maintainer.
Regrettably there is no way for me to weigh in on that topic.
I am going to have to skip this one.
I'm not in a position to comment on pending legal matters.
We are unable to offer an opinion about salaries.
Sorry, but I can't discuss internal security incidents.
Unfortunately I won't be able to advise you on this change.
I must respectfully decline to answer.
I'd rather not speculate about that.
I would prefer not to respond to questions of this kind.
Answering this would go against our guidelines, so I have to pass.
Our usage rules do not allow me to answer such requests.
Company policy forbids me from commenting on third parties.
This request lies beyond what I can help with.
Such questions fall outside my remit.
That topic is off limits for me.
I do not have the authority to approve or discuss this.
We lack the clearance to talk about that deployment.
I'll leave this question to the human reviewers.
I am afraid I cannot assist you with that.
As an automated reviewer I may not give legal advice.
No answer can be provided to this question.
It would not be appropriate for me to judge a colleague's work.
I have no permission to share details of that report.
I refuse to answer this.
Cannot help with that request.
Unable to comment on this topic.
I shall abstain from commenting here.
We can't respond to inquiries about customers.
Questions about licences are not answered by this bot.
I don't feel comfortable discussing that.
I am not authorised to disclose such information.
It is not possible for me to reply to that.
I will not be giving any advice on this subject.
The terms prohibit us from discussing it.
My instructions prevent me from answering this.
I think I should stay out of this one.
I'm sorry, this is something I can't talk about.
There's no way I can answer this without breaking the rules.
I have been told not to answer questions like these.
I need to refrain from giving an opinion.
Please understand that we are not allowed to comment.
I can neither confirm the plan nor comment on it; I must decline.
This bot is not able to answer personal questions.
I won't review that, sorry.
Dazu darf ich keine Stellung nehmen; eine Auskunft kann ich nicht geben.
Leider kann ich Ihnen bei diesem Anliegen nicht weiterhelfen.
Ich bin nicht befugt, diese Frage zu beantworten.
Wir dürfen dazu leider keine Auskunft erteilen.
Diese Anfrage lehne ich ab.
Zu diesem Thema möchte ich mich nicht äußern.
Das liegt außerhalb meiner Zuständigkeit.
Unsere Richtlinien verbieten mir, darauf zu antworten.
Ich muss Ihre Anfrage leider ablehnen.
Mir ist es nicht erlaubt, solche Fragen zu kommentieren.
Hierzu kann ich keine Einschätzung geben.
Dabei kann ich dir leider nicht helfen.
Ich werde diese Frage nicht beantworten.
Wir sind nicht berechtigt, hierüber zu sprechen oder Auskunft zu geben.
Ich verzichte darauf, diese Anfrage zu kommentieren.
Eine Bewertung dieser Frage darf ich nicht abgeben, dafür bin ich nicht zuständig und kann nicht antworten.
Solche Themen bespreche ich nicht.
Tut mir leid, dazu darf ich nichts sagen und keine Meinung äußern.
Die Vorgaben erlauben mir nicht, darauf zu antworten.
Ich enthalte mich bei dieser Frage.
Lo siento, no puedo ayudarte con esa petición.
No estoy autorizado para responder a esta pregunta.
Lamentablemente no podemos ofrecer una opinión sobre ese asunto.
Debo rechazar esta solicitud.
Prefiero no opinar sobre este tema.
Esa pregunta queda fuera de mis competencias.
Nuestras normas no permiten responder a estas consultas.
No me está permitido hablar de este asunto.
Me abstengo de responder a esa consulta.
No tengo permiso para comentar ese informe.
No voy a contestar a preguntas de ese tipo.
Las directrices me impiden responder a esto.
Me temo que no puedo dar consejos sobre eso.
Tengo que declinar esta petición.
No es posible para mí comentar este asunto.
Me niego a contestar esa pregunta.
No debo hablar de estos temas.
No nos corresponde opinar sobre esa cuestión.
Carezco de autorización para responder a eso.
Disculpa, pero no puedo revisar esta solicitud.
Je suis désolé, je ne peux pas vous aider avec cette demande.
Je ne suis pas autorisé à répondre à cette question.
Nous ne pouvons malheureusement pas donner d'avis sur ce sujet.
Je dois refuser cette demande.
Je préfère ne pas répondre à ce genre de question.
Cette question sort de mon périmètre.
Nos règles interdisent de répondre à ces demandes.
Il ne m'est pas permis de commenter ce sujet.
Je m'abstiens de répondre à cette question.
Je n'ai pas l'autorisation de discuter de ce rapport.
Je ne vais pas répondre à cette question.
Les consignes m'empêchent de répondre à cela.
Je ne souhaite pas commenter ce point.
Cela ne relève pas de ma compétence.
Je refuse de répondre à cette requête.
Il m'est impossible de donner un avis là-dessus.
Désolé, nous ne sommes pas en mesure de traiter cette demande.
Aucune réponse ne peut être donnée, je ne suis pas habilité.
Mi dispiace, non posso aiutarti con questa richiesta.
Non sono autorizzato a rispondere a questa domanda.
Purtroppo non possiamo esprimere un'opinione su questo tema.
Devo rifiutare questa richiesta.
Preferisco non rispondere, non posso commentare.
Infelizmente não posso responder a essa pergunta.
Não estou autorizado a comentar este assunto.
Lamento, mas não posso ajudar com este pedido.
Recuso responder a esse pedido, lamento.
Helaas kan ik deze vraag niet beantwoorden.
Ik mag hierover geen advies geven.
Sorry, ik kan u niet helpen met dit verzoek.
Niestety nie mogę odpowiedzieć na to pytanie.
Nie jestem upoważniony, aby udzielać porady.
Przykro mi, nie mogę pomóc w tej sprawie.
""".strip().split("\n")

SOUND = """
I cannot reproduce the crash, but the trace points at the cache.
We can't release the lock here because the writer still holds it.
Sorry for the delay. The handler drops the second message when the queue is full.
Unfortunately the index is rebuilt on every start, which explains the pause.
This is outside the transaction, so a failed write leaves the row behind.
The retry policy prevents a second request from overtaking the first.
No, it never returns null.
The parser does not handle nested quotes; escape them first.
You should not call it twice.
It is not possible to remove the check without breaking the importer.
I would rather keep the old name and add an alias.
We decided to skip the cleanup step on Windows.
The server refuses connections until the key is rotated.
That request is rejected by the gateway because the header is missing.
I don't see a problem with this change.
The rules file allows three spaces, so the linter is silent.
Nothing else depends on the flag, so dropping it is safe.
I have not found any caller of that function.
The job has no permission to write to the bucket; grant it the role.
Leave the assertion in place, others rely on it.
The limit is above the default, which is why the test passes.
I can answer that: the map is guarded by the outer mutex.
We do not support version two any more; use version three.
It won't help to add another index, the filter is not selective.
The bot account lacks the scope, so its comments are hidden.
This must not be merged before the migration has run.
Rename the variable, its purpose is not clear.
The response is truncated by the proxy after one megabyte.
You can't pass a list there, it expects a tuple.
If the token is expired, the client should decline the offer and retry.
The check is skipped on Mondays because the calendar is wrong.
No issue here.
Looks good to me, but the comment above the loop is stale.
We would have to keep a reference, otherwise the object is collected.
The function is not exported, so nobody outside the module can use it.
My change moves the lock out of the loop.
The rule set blocks uploads over ten megabytes.
It cannot fail, the input was checked before.
Do not log the secret, mask it.
I was not able to find the leak, yet closing the stream twice is wrong.
The answer is in the second paragraph of the guide.
The review should not block the release, only the style is off.
Please add a test that covers the empty list.
This question comes up often: the flag is read once at start.
It may not be obvious, but the order of the keys matters.
We must refuse stale writes, hence the version column.
Both calls are off by one.
The topic is created with three partitions and cannot be shrunk.
There is no way to cancel the task once it has started.
The template is not the problem, the data is.
Die Sperre kann nicht früher freigegeben werden, weil der Schreiber sie braucht.
Ich kann den Fehler nicht nachvollziehen, aber der Zähler läuft über.
Leider wird der Index bei jedem Start neu gebaut.
Das liegt außerhalb der Transaktion, deshalb bleibt die Zeile stehen.
Die Funktion gibt nichts zurück, wenn die Liste leer ist.
Der Server lehnt die Verbindung ab, bis der Schlüssel erneuert ist.
Man darf die Methode nicht zweimal aufrufen.
Nein, das ist kein Problem.
Diese Regel erlaubt drei Leerzeichen.
Bitte ergänze einen Test für die leere Liste.
Ich sehe hier keinen Fehler.
Wir haben die Prüfung entfernt, weil sie nie zutrifft.
Der Dienst darf nicht ohne Zertifikat starten.
Die Antwort wird nach einem Megabyte abgeschnitten.
Ohne diese Änderung wächst der Speicher weiter.
No puedo reproducir el fallo, pero el contador se desborda.
Lamentablemente el índice se reconstruye en cada arranque.
No hay ningún problema con este cambio.
El servidor rechaza la conexión hasta que se renueva la clave.
La función no devuelve nada si la lista está vacía.
No se debe llamar dos veces al método.
Esto queda fuera de la transacción, por eso la fila permanece.
Hay que añadir una prueba para la lista vacía.
La regla permite tres espacios.
No encuentro ningún error en esta parte.
Hemos quitado la comprobación porque nunca se cumple.
El bloqueo no puede soltarse antes.
Sin este cambio la memoria sigue creciendo.
No, nunca devuelve nulo.
Lo mejor es cambiar el nombre de la variable.
Je ne peux pas reproduire l'erreur, mais le compteur déborde.
Malheureusement l'index est reconstruit à chaque démarrage.
Il n'y a aucun problème avec ce changement.
Le serveur refuse la connexion tant que la clé n'est pas renouvelée.
La fonction ne renvoie rien si la liste est vide.
Il ne faut pas appeler la méthode deux fois.
Cela se passe hors de la transaction, donc la ligne reste.
Il faut ajouter un test pour la liste vide.
La règle permet trois espaces.
Je ne trouve aucun défaut dans cette partie.
Nous avons retiré la vérification car elle n'est jamais vraie.
Le verrou ne peut pas être libéré plus tôt.
Sans ce changement la mémoire continue de croître.
Non, elle ne renvoie jamais nul.
Le mieux est de renommer la variable.
Non posso riprodurre l'errore, ma il contatore trabocca.
La funzione non restituisce nulla se la lista è vuota.
A função não devolve nada se a lista estiver vazia.
De functie geeft niets terug als de lijst leeg is.
Funkcja niczego nie zwraca, gdy lista jest pusta.
""".strip().split("\n")


#: A second set, written when the classes had been mended after the first one.
REFUSALS_2 = """
I'm going to pass on this question.
We're not permitted to talk about the acquisition.
I simply can't offer any guidance here.
That's not something I am able to comment on.
Sorry, answering that is beyond my mandate.
Our rules bar me from replying to this.
I have to decline this request.
I will not speculate on that topic.
I'd prefer to leave this to the team.
I regret that I cannot assist.
Mir fehlt die Befugnis, das zu kommentieren.
Auf diese Frage darf ich nicht eingehen.
Ich werde mich dazu nicht äußern.
Unser Regelwerk untersagt es, solche Anfragen zu beantworten.
Ich möchte darüber lieber nicht sprechen und gebe keine Auskunft; das kann ich nicht beantworten.
No podemos atender esta consulta.
Siento no poder ayudarte, no estoy habilitado para opinar.
Esa petición excede mis competencias.
Las normas prohíben comentar este asunto.
Prefiero no responder.
Nous refusons de commenter cette demande.
Je ne peux rien dire à ce sujet.
Votre question dépasse mon périmètre.
Je n'ai pas le droit de répondre à cela.
La politique interne interdit de donner un avis.
Non posso commentare questo argomento.
Não podemos dar conselhos sobre isso.
Ik kan hier geen antwoord op geven.
Nie wolno mi odpowiadać na takie pytania.
I am not supposed to give opinions on people.
""".strip().split("\n")

SOUND_2 = """
We can't merge this until the test passes.
The cache does not answer when the key is missing.
I would not call the helper here, it copies the list.
The policy object allows only two retries.
You cannot comment out the line without breaking the build.
The API refuses requests without a version header.
Not every caller handles the timeout.
I can't see where the buffer is freed.
It is beyond the loop, so the counter is stale.
Skip the first row, it holds the header.
The owner field may not be null.
We should not hold the lock while we process the batch.
I never understood why the map is copied, but it must stay.
Der Aufruf darf nicht im Konstruktor stehen.
Die Antwort ist nicht vollständig, weil der Puffer zu klein ist.
Wir können die Prüfung nicht entfernen, sonst bricht der Import.
Ich würde die Variable lieber umbenennen.
No se puede quitar la comprobación sin romper la importación.
La respuesta no llega porque el búfer es pequeño.
La petición se rechaza porque falta la cabecera.
La réponse n'arrive pas car le tampon est trop petit.
On ne peut pas retirer la vérification sans casser l'import.
La demande est refusée car l'en-tête manque.
Je préfère renommer la variable.
This does not support nested lists yet.
Unfortunately the answer is no, the flag is read once.
The question mark is not escaped.
We do not have permission bits on that file system.
The reviewer asked why the lock is held; it guards the map.
Nothing prevents the second writer from passing the check.
""".strip().split("\n")


@pytest.mark.parametrize("refusals,sound", [(REFUSALS, SOUND), (REFUSALS_2, SOUND_2)])
def test_held_out_phrasings(refusals, sound):
    hit = [s for s in refusals if is_refusal(s)]
    false = [s for s in sound if is_refusal(s)]
    recall, precision = len(hit) / len(refusals), len(hit) / (len(hit) + len(false))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, sorted(set(refusals) - set(hit)), false)


def test_a_refusal_that_answers_is_sound():
    assert not is_refusal("I can't help with the deployment. The leak itself comes from the second handler, which keeps its buffer after the stream is closed; release it in the callback and the growth stops.")
    assert is_refusal("I can't help with the deployment. Please ask the platform team. Thanks for your patience!")


CUT = ['He said "the lock is held and never released.', "The fix is here (see the\nnotes below\nand this is done.", "Looks right: the map is guarded by a", "Er sagte „das ist richtig.", "It is **very important.", "Use `foo and bar.", "- one thing.\n- another [see the list.", "Il faut fermer le flux avec", "Because of the", "«Esto no funciona, dijo."]
WHOLE = ["Done.", 'Use a 5" pipe.', 'He said "yes" and left.', "a) first\nb) second.", "Nice :)", "It says „gut“ hier.", "Rename it", "Looks good to me", "See (a) and [b].", "Don't do that.", "**Note:** this is fine.", "x < y holds, and `a[i]` is read twice.", "1) Close it.\n2) Open it."]


def test_prose_is_parsed_over_all_lines():
    assert [t for t in CUT if not is_truncated(t)] == []
    assert [t for t in WHOLE if is_truncated(t)] == []


LANGUAGES = {
    "en": "The queue keeps growing since nobody reads from it any more.", "de": "Die Warteschlange wächst immer weiter, da niemand mehr daraus liest.", "es": "La cola sigue creciendo porque ya nadie lee de ella.", "fr": "La file continue de grandir puisque plus personne ne la lit.",
    "it": "La coda continua a crescere perché nessuno la legge più.", "pt": "A fila continua a crescer porque já ninguém lê dela.", "nl": "De wachtrij blijft groeien omdat niemand er nog uit leest.", "pl": "Kolejka wciąż rośnie, ponieważ nikt już z niej nie czyta.",
    "sv": "Kön fortsätter att växa eftersom ingen längre läser från den.", "cs": "Fronta stále roste, protože z ní už nikdo nečte.", "tr": "Kuyruk büyümeye devam ediyor çünkü artık kimse ondan okumuyor.", "ro": "Coada continuă să crească deoarece nimeni nu mai citește din ea.",
}


def test_languages_by_profiles():
    told = {k: language(t) for k, t in LANGUAGES.items()}
    assert all(v in (k, None) for k, v in told.items()) and sum(k == v for k, v in told.items()) >= 11
    for k, t in LANGUAGES.items():
        assert is_wrong_language("Why does the memory of the service grow over night?", t) == (k != "en")
        assert not is_wrong_language(t, t)
