"""Ways to decline, and ways to deny something in a sound answer: small grammars from which training answers are drawn.

They were written from general knowledge of how people and assistants decline, not from any table. A rule is a list of
alternatives, `|` between them, in which {name} stands for a draw of another rule.
"""

from __future__ import annotations

import re

import numpy as np

# Grammars of refusals by language; the rule `say` is the start.
REFUSALS = {
    "en": {
        "say": "{sorry}{core}{tail}|{sorry}{core}{tail}|{lead}{sorry}{core}{tail}|{core}{tail}",
        "core": "{can't} {do}|{can't} {do}|{can't} {do} {why}|{role}, {can't} {do}|{lack}|{lack}|{lack}, so {can't} {do}|{unknown}|{no}|{lack}, hence {no}|{passive}|{passive}|{topic}",
        "can't": "I can't|I cannot|I'm not able to|I am not able to|I'm unable to|I'm afraid I can't|I won't|I will not|I could not|I couldn't|we cannot|we are unable to|I may not|I'm not allowed to|I am not permitted to|I'm not in a position to|it isn't possible for me to|it is impossible to|I have to decline to|I'd prefer not to|I choose not to|I refuse to|I shouldn't|I don't want to|I am not going to|I don't feel able to|there is no way to|nobody could|unable to|not able to|I have been instructed not to|I was told not to|I find myself unable to|I don't see how to|I would need more {facts} to|I'd need further {facts} to|I lack what I need to|I don't have what it takes to|I am forbidden to|my rules forbid me to|my instructions do not let me|I am missing the {facts} to|I have not been given enough to|I see no way to|I feel unable to",
        "do": "answer|answer it|answer this one|answer your question|reply to that|respond|say|say for certain|tell|tell you that|be of help here|help|help you here|assist|assist you with it|comment|comment on it|give an opinion|give advice|make a statement|share these details|give that information|provide an answer|discuss it|go into that|decide this|judge it|determine that|work that out|find out|advise you here|take a position|complete the request|do what you ask|provide what you ask for|settle this from the text|name a value|give a reliable answer|comply|comply with this|talk about that|talk about this topic|offer an answer|offer guidance|speak to that|give a proper reply|resolve it|confirm it|verify that|conclude anything|draw a conclusion|locate the answer|find that in {text}|decide either way|deal with this request|process that|fulfil it|support you with that",
        "why": "from {text}|on the basis of {text}|without more {facts}|because {lack2}|as {lack2}|since {lack2}|for lack of {facts}|with what I have",
        "text": "the text|this text|the document|these documents|the passage|the material|the source|the sources given|the excerpt|what I was given|the provided context|the pages",
        "facts": "information|data|details|evidence|facts|context|background",
        "lack": "{lack2}|{lack2}|{text} {silent}|{text} {silent}|no {facts} on this {found}|nothing about that {found}|an answer {notfound}|the answer {notfound}|this {notfound}|the question {unanswerable}|your question {unanswerable}|{text} {holds} no {facts} on it|{text} {holds} nothing of the kind|none of {text} {silent2}|nothing in {text} {silent2}|nothing I have seen {silent2}|no basis for an answer|no {facts} available|not stated|not specified in {text}|not mentioned in {text}|could not find it in {text}|I find nothing about it in {text}|I found no answer in {text}|I see no {facts} on that|{text} left that out",
        "lack2": "there is {little} {facts}|there is {little} {facts} in {text}|there isn't enough {facts}|I have {little} {facts}|I lack the {facts}|the {facts} {short}|I was given {little} {facts}|it {notfound}",
        "little": "no|too little|insufficient|not enough|hardly any|not sufficient",
        "short": "are not sufficient|do not suffice|is missing|are missing|is insufficient|is too thin|don't reach that far|is not enough for an answer",
        "silent": "does not say|doesn't mention it|is silent on this|says nothing about it|gives no answer|does not cover that|leaves this open|does not provide the answer|doesn't include that {facts}|does not allow an answer|does not tell me that|does not specify this",
        "found": "is given|is available|can be found|could be found|was supplied|is included|appears in {text}|is available to me",
        "notfound": "is not given|is not in {text}|cannot be found|cannot be derived from {text}|can't be determined|is not stated anywhere|could not be located|is not available to me|cannot be taken from {text}",
        "holds": "holds|has|contains|offers|provides|includes|gives|brings",
        "silent2": "addresses that|answers this|covers the point|tells me|lets me decide|helps here|settles the matter|mentions it|supports an answer",
        "passive": "this cannot be {done}|that can't be {done}|it could not be {done}|an answer cannot be {done}|the request can't be {done}|the question cannot be {done} with {text}",
        "done": "answered|determined|given|provided|fulfilled|resolved|decided|found|derived|confirmed|processed",
        "topic": "this is not covered|that topic is off limits|this is a matter for {who}|that is a question for {who}, not for me|it's not my place to say|this lies beyond my remit|this is beyond the scope of {text}|I am the wrong one to ask|I stay out of such matters|I keep silent on that|that is confidential|it is too sensitive to discuss",
        "unanswerable": "cannot be answered|can't be answered here|can't be answered from {text}|is not answerable|goes beyond what I can answer|has no answer in {text}|is outside my scope",
        "unknown": "I don't know|I do not know|I don't know that|I have no idea|I'm not sure|I am not certain|no idea|I have no knowledge of it|that is beyond what I know|this exceeds my knowledge|it's outside my expertise|that isn't known to me|I don't have that {facts}|I do not have an answer",
        "no": "no comment|no comment on that|I must turn this down|I have to pass|I pass on this one|I decline|I respectfully decline|this isn't something I deal with|I have nothing to say on that|I have no opinion on that|my answer would be a guess|I'd only be guessing|that request is refused|I can't do that|please don't ask me that|it would be wrong of me to answer|I am going to leave this unanswered|answering this would go against my rules|I don't answer such questions|I don't give advice of that kind",
        "role": "as an AI|as an AI system|as a chatbot|as an automated assistant|being a language model|as a virtual assistant|as a machine|under my guidelines",
        "sorry": "|||sorry, |sorry, but |I'm sorry, |I am sorry, but |I apologize, but |my apologies: |unfortunately, |unfortunately |regrettably, |I'm afraid |I regret that |sadly, ",
        "lead": "well, |honestly, |thank you for asking. |good question. |let me think. |based on the text: |having read the pages: |to be frank, |hm, |okay. ",
        "tail": "|||||. please ask {who}|. you should speak to {who}|; try {who}|. please contact {who}|, please ask again later|. perhaps rephrase the question|. is there anything else you need?|. please provide more {facts}",
        "who": "an expert|a specialist|somebody else|a professional|the manufacturer|a qualified person|your supervisor|another source",
    },
    "de": {
        "say": "{sorry}{core}{tail}|{lead}{core}{tail}|{core}{tail}",
        "core": "{modal} {nicht}|{modal} {nicht}|{modal} {nicht}|{lack}|{lack}|{unknown}|{no}|{role} {kann} ich {nicht}|ich bin nicht {able}, {zu}|ich sehe mich nicht {able}, {zu}|es ist mir nicht möglich, {zu}|mir fehlen {facts}, um {zu}|ohne weitere {facts} {kann} ich {nicht}|{lack}, daher {kann} ich {nicht}|es ist {possible}, {zu}|{passive}|{passive}|{topic}",
        "modal": "ich kann|ich kann|ich darf|ich werde|ich will|wir können|ich möchte|leider kann ich|bedauerlicherweise darf ich|hier kann ich|ich konnte|an dieser Stelle möchte ich|ich sollte",
        "kann": "kann|darf|möchte|werde",
        "able": "in der Lage|imstande|befugt|berechtigt",
        "possible": "nicht möglich|unmöglich|mir nicht gestattet",
        "nicht": "darauf nicht antworten|das nicht sagen|das nicht beurteilen|das leider nicht verraten|hier nicht weiterhelfen|Ihnen dabei leider nicht helfen|das so nicht beantworten|die Frage nicht beantworten|Ihre Frage nicht beantworten|dazu keine Stellung nehmen|dazu nichts sagen|darüber nichts sagen|mich dazu nicht äußern|keine Angaben machen|keine Antwort geben|diese Auskunft nicht geben|keinen Rat geben|den Wert nicht nennen|diese Bitte nicht erfüllen|die Anfrage nicht bearbeiten|das nicht entscheiden|nicht helfen|keine Einschätzung abgeben|das aus {text} nicht ableiten|dabei nicht behilflich sein|Sie hier nicht unterstützen|Ihnen keine Empfehlung geben|dazu keine Auskunft erteilen|darüber nicht sprechen|darüber nicht entscheiden|das nicht bestätigen|dem nicht nachkommen|die Antwort nicht finden|in {text} nichts dazu finden|das nicht feststellen|nicht weiter darauf eingehen|keinen Rat erteilen|die Beantwortung nicht übernehmen",
        "zu": "das zu beantworten|darauf zu antworten|das zu beurteilen|dazu etwas zu sagen|Ihnen zu helfen|eine Antwort zu geben|das zu entscheiden|Auskunft zu geben|die Frage zu beantworten|das aus {text} zu erschließen",
        "text": "dem Text|dem Dokument|den Unterlagen|der Quelle|dem Material|dem Auszug|den Seiten|dem Abschnitt",
        "Text": "der Text|das Dokument|die Quelle|das Material|der Auszug|der Abschnitt|der gegebene Kontext",
        "facts": "Angaben|Daten|Informationen|Belege|Hinweise|Einzelheiten",
        "lack": "{Text} {silent}|{Text} {silent}|{about} {missing}|{about} {missing}|die {facts} {short}|es fehlen {facts}, um {zu}|es gibt {little} {facts}|in {text} {missing2}|eine Antwort {notfound}|das {notfound}|die Frage {notfound}|{about} steht in {text} nichts|{about} finde ich nichts|mir fehlen die nötigen {facts}|mir liegen keine {facts} vor|mit diesen {facts} ist keine Antwort möglich|auf dieser Grundlage {notfound}|keine {facts} vorhanden|{Text} {holds} keine Antwort|{Text} {holds} nichts {about}",
        "holds": "enthält|liefert|bietet|gibt|nennt|hat",
        "passive": "das kann nicht {done} werden|die Frage kann hier nicht {done} werden|eine Antwort kann nicht {done} werden|das lässt sich so nicht sagen|eine Beantwortung ist nicht möglich|eine Aussage {about} ist nicht möglich|das lässt sich nicht klären|das ist so nicht zu beantworten",
        "done": "beantwortet|gegeben|ermittelt|bestimmt|erteilt|geklärt|entschieden|bestätigt",
        "topic": "das ist nicht mein Gebiet|dafür bin ich nicht zuständig|das fällt nicht in meinen Bereich|diese Frage geht an {who}|das ist vertraulich|darüber wird nicht gesprochen|ich muss die Antwort schuldig bleiben|ich muss eine Antwort ablehnen|die Beantwortung lehne ich ab",
        "silent": "sagt dazu nichts|gibt darüber keine Auskunft|enthält hierzu keine {facts}|nennt das nicht|schweigt dazu|beantwortet das nicht|lässt das offen|liefert keine Antwort|gibt das nicht her|erlaubt keine Antwort",
        "about": "dazu|hierzu|darüber|zu diesem Punkt",
        "missing": "liegen mir keine {facts} vor|ist mir nichts bekannt|habe ich keine {facts}|fehlt mir das Wissen|findet sich nichts|steht nichts in {text}|gibt es keine {facts}|wird nichts gesagt|lässt sich nichts sagen",
        "missing2": "steht dazu nichts|findet sich keine Antwort|fehlen die {facts}|ist das nicht erwähnt|gibt es keine {facts} dazu",
        "little": "zu wenig|nicht genug|keine|nicht genügend|kaum",
        "short": "reichen nicht|reichen dafür nicht aus|genügen nicht|sind unzureichend|fehlen|sind zu dürftig",
        "notfound": "lässt sich nicht finden|lässt sich aus {text} nicht entnehmen|ist nicht zu ermitteln|ist leider nicht möglich|kann nicht beantwortet werden|geht aus {text} nicht hervor|bleibt offen",
        "unknown": "das weiß ich nicht|weiß ich leider nicht|ich weiß es nicht|keine Ahnung|mir ist das nicht bekannt|da bin ich überfragt|das entzieht sich meiner Kenntnis|ich bin mir nicht sicher|das übersteigt mein Wissen|ich habe keine Antwort darauf",
        "no": "das lehne ich ab|ich lehne das ab|darüber spreche ich nicht|kein Kommentar|ich verzichte auf eine Antwort|darauf gebe ich keine Antwort|da muss ich passen|das muss ich verweigern|ich sage dazu nichts|dazu habe ich keine Meinung|das wäre nur geraten|solche Fragen beantworte ich nicht|bitte haben Sie Verständnis, dass ich dazu schweige|ich nehme dazu keine Stellung",
        "role": "als KI|als Chatbot|als Assistent|als Programm|als maschinelles System|nach meinen Regeln",
        "sorry": "|||Entschuldigung, |tut mir leid, |tut mir leid: |bedaure, |Verzeihung, |leider nein: |ich bedaure, aber |leider: ",
        "lead": "nun, |ehrlich gesagt: |danke für die Frage. |gute Frage. |nach dem Lesen der Seiten: |hm, ",
        "tail": "|||||. bitte fragen Sie {who}|. wenden Sie sich an {who}|. stellen Sie bitte eine andere Frage|. bitte liefern Sie mehr {facts}",
        "who": "eine Fachkraft|einen Fachmann|jemand anderen|den Hersteller|die zuständige Stelle",
    },
    "fr": {
        "say": "{sorry}{core}{tail}|{lead}{core}{tail}|{core}{tail}",
        "core": "{cannot} {do}|{cannot} {do}|{cannot} {do} {why}|{lack}|{lack}|{unknown}|{no}|{role}, {cannot} {do}|{lack}, donc {cannot} {do}|{passive}|{passive}|{topic}",
        "cannot": "je ne peux pas|je ne peux pas|je ne peux vraiment pas|je ne suis pas capable de|il m'est impossible de|il n'est pas possible de|je suis incapable de|je ne souhaite pas|je refuse de|je m'abstiens de|je ne veux pas|nous ne pouvons pas|je ne saurais|je n'ai pas le droit de|on ne peut pas|je dois éviter de|j'aime mieux ne pas|je ne vais pas|je ne puis|je ne suis pas autorisé à|je ne suis pas habilité à|je suis dans l'impossibilité de|je ne suis pas en position de|impossible de|je ne parviens pas à|on m'a demandé de ne pas|il m'est défendu de|je n'ai pas de quoi|je ne vois pas comment|je n'arrive pas à|je ne peux hélas pas|je préfère ne pas",
        "do": "répondre|y répondre|vous répondre|le dire|vous le dire|vous aider|vous aider ici|aider|donner cette information|me prononcer|commenter|commenter ce sujet|traiter cette requête|fournir ce renseignement|donner un conseil|donner une réponse|trancher|indiquer la valeur|faire ce que vous demandez|en parler|en dire plus|juger|déterminer cela|vous conseiller|vous renseigner|vous orienter|vous éclairer|conclure|confirmer cela|trouver la réponse|trouver cela dans le document|satisfaire cette demande|aller plus loin|discuter de ce point|vous assister|établir cela",
        "why": "à partir {text}|d'après ce qui est donné|sans plus {facts}|faute {facts}|avec si peu {facts}",
        "text": "du texte|du document|de la source|de l'extrait|du passage|des pages",
        "Text": "le texte|le document|la source|l'extrait|le passage|le contexte donné|la page",
        "facts": "d'informations|de données|d'éléments|de précisions|d'indications|de détails",
        "lack": "{Text} {silent}|{Text} {silent}|{nothing} {found}|il n'y a pas {enough} {facts}|il n'y a pas {enough} {facts} pour {do}|je n'ai pas {enough} {facts}|il manque trop {facts}|les données {short}|la réponse {notfound}|cela {notfound}|votre question {notfound}|je ne trouve rien {sur}|je ne trouve pas cela dans le document|je n'ai rien trouvé {sur}|je manque {facts}|je ne dispose pas {facts}|je ne dispose d'aucune donnée|on ne m'a pas donné {facts}|cette donnée ne m'est pas connue|il me manque les éléments pour {do}|{Text} {holds} aucune réponse|{Text} {holds} rien {sur}|pas {facts} disponibles",
        "silent": "ne dit rien à ce sujet|ne donne aucune indication|ne précise rien là-dessus|n'indique rien|ne fournit pas la réponse|n'en parle pas|ne mentionne pas cela|ne permet aucune réponse|reste muet sur ce point|n'apporte pas de réponse",
        "sur": "à ce sujet|sur ce point|là-dessus|à cet égard",
        "holds": "ne contient|n'offre|ne donne|n'apporte|ne fournit|ne comporte",
        "passive": "la question ne peut pas être traitée|cela ne peut pas être établi|aucune réponse ne peut être donnée|la demande ne peut être satisfaite|cela ne se laisse pas déduire|une réponse n'est pas possible ici",
        "topic": "ce n'est pas mon domaine|cela ne relève pas de moi|c'est une question pour {who}|c'est confidentiel|je ne suis pas la bonne personne|je reste muet là-dessus|ce sujet m'est interdit|cela dépasse mon champ",
        "nothing": "aucune information|aucun élément|rien|aucune donnée|aucune réponse",
        "found": "n'est donné à ce sujet|n'apparaît ici|ne figure dans la source|n'est disponible|ne se trouve dans ces pages|n'est fourni",
        "enough": "assez|suffisamment|",
        "short": "sont insuffisantes|ne suffisent pas|manquent|font défaut|sont trop maigres",
        "notfound": "ne figure pas ici|est introuvable|n'est pas indiqué|ne peut être déduit|reste sans réponse|ne se trouve pas dans ces pages|n'est pas de mon ressort|ne peut pas être établi",
        "unknown": "je l'ignore|je ne sais pas|je ne le sais pas|aucune idée|je n'en sais rien|cela dépasse mes connaissances|je n'ai pas cette information|je n'ai pas la réponse|je n'en suis pas sûr|cela m'est inconnu",
        "no": "pas de commentaire|sans commentaire|je décline cette demande|je décline|je passe mon tour|je n'ai rien à dire là-dessus|ma réponse serait une supposition|je ne réponds pas à ce genre de question|je laisse cela sans réponse|je n'ai pas d'opinion là-dessus|cette demande est refusée",
        "role": "en tant qu'IA|en tant que programme|comme assistant virtuel|étant un modèle de langue|selon mes règles",
        "sorry": "|||désolé, |désolé, mais |navré, |malheureusement, |je regrette, |mes excuses, |pardon, |je suis navré, mais |hélas, ",
        "lead": "eh bien, |franchement, |merci pour la question. |bonne question. |après lecture des pages : |hum, ",
        "tail": "|||||. adressez-vous à {who}|. demandez à {who}|. posez une autre question|. veuillez contacter {who}|. merci de préciser",
        "who": "un spécialiste|une personne compétente|quelqu'un d'autre|un professionnel|le fabricant",
    },
    "es": {
        "say": "{sorry}{core}{tail}|{lead}{core}{tail}|{core}{tail}",
        "core": "{cannot} {do}|{cannot} {do}|{cannot} {do} {why}|{lack}|{lack}|{unknown}|{no}|{role}, {cannot} {do}|{lack}, así que {cannot} {do}|{passive}|{passive}|{topic}",
        "cannot": "no puedo|no puedo|no me es posible|no es posible|me es imposible|soy incapaz de|no quiero|no deseo|me niego a|me abstengo de|no podemos|no debo|no estoy autorizado a|no tengo permiso para|no soy capaz de|no voy a|evito|mejor no|no me corresponde|tengo que renunciar a|no estoy en condiciones de|me resulta imposible|imposible|no consigo|no logro|no me está permitido|me han pedido no|no encuentro cómo|no veo cómo|no cuento con lo necesario para|prefiero no|no sabría|me veo obligado a no|tengo prohibido|no me atrevo a",
        "do": "responder|contestar|responderle|decirlo|decírselo|ayudar|ayudarle aquí|ayudarte con esto|dar esa información|dar una opinión|dar consejo|comentar|comentar ese tema|atender la petición|facilitar ese dato|dar una respuesta|decidirlo|indicar el valor|hacer lo que pide|hablar de ello|decir más|determinarlo|pronunciarme|aconsejarle|orientarle|informarle|concluir nada|confirmarlo|encontrar la respuesta|encontrar eso en el texto|cumplir la petición|tratar ese asunto|ofrecer orientación|apoyarle en esto|establecerlo|resolverlo|darle una respuesta",
        "why": "a partir {text}|con lo que se da|sin más {facts}|por falta de {facts}|con tan pocos {facts}",
        "text": "del texto|del documento|de la fuente|del extracto|del pasaje|de las páginas",
        "Text": "el texto|el documento|la fuente|el extracto|el pasaje|el material|la página",
        "facts": "datos|información|elementos|detalles|indicios|antecedentes",
        "lack": "{Text} {silent}|{Text} {silent}|{nothing} {found}|no hay {enough} {facts}|no hay {enough} {facts} para {do}|no tengo {enough} {facts}|faltan {facts}|faltan {facts} para {do}|los datos {short}|la respuesta {notfound}|eso {notfound}|su pregunta {notfound}|no encuentro nada {sobre}|no encuentro eso en el documento|no he hallado respuesta {sobre}|carezco de {facts}|no dispongo de {facts}|no cuento con {facts}|no me han dado {facts}|me faltan {facts}|{Text} {holds} ninguna respuesta|{Text} {holds} nada {sobre}|sin {facts} disponibles|no consta ningún dato {sobre}",
        "silent": "no dice nada al respecto|no da ninguna indicación|no precisa nada sobre eso|no indica nada|no ofrece la respuesta|no habla de eso|no menciona ese punto|no permite una respuesta|calla sobre este punto|no lo aclara",
        "sobre": "sobre eso|al respecto|sobre este punto|en ese sentido",
        "holds": "no contiene|no ofrece|no da|no aporta|no brinda|no incluye",
        "passive": "la pregunta no puede tratarse|eso no puede establecerse|no se puede dar una respuesta|la petición no se puede cumplir|eso no se deja deducir|no cabe respuesta aquí",
        "topic": "no es mi terreno|eso no me compete|es una pregunta para {who}|es confidencial|no soy la persona indicada|guardo silencio sobre eso|ese tema me está vedado|queda fuera de mi alcance",
        "nothing": "ninguna información|ningún dato|nada|ninguna respuesta",
        "found": "se da al respecto|aparece aquí|figura en la fuente|está disponible|se encuentra en estas páginas|consta",
        "enough": "bastantes|suficientes|bastante|",
        "short": "son insuficientes|no alcanzan|no bastan|faltan|son muy escasos",
        "notfound": "no figura aquí|no se encuentra|no está indicada|no se puede deducir|queda sin respuesta|no es de mi competencia|no puede establecerse|no consta en el texto",
        "unknown": "lo ignoro|no lo sé|no sé|no tengo idea|ni idea|eso supera mis conocimientos|no tengo esa información|no tengo la respuesta|no estoy seguro|lo desconozco",
        "no": "sin comentarios|rechazo la petición|declino responder|paso|no tengo nada que decir sobre eso|mi respuesta sería una suposición|no contesto a preguntas así|lo dejo sin respuesta|no tengo opinión sobre eso|la petición queda rechazada",
        "role": "como IA|como programa|como asistente virtual|al ser un modelo de lenguaje|según mis normas",
        "sorry": "|||perdón, |perdone, pero |lamentablemente, |por desgracia, |disculpe, |mis disculpas, |lo lamento, |lo lamento, pero ",
        "lead": "bueno, |francamente, |gracias por la pregunta. |buena pregunta. |tras leer las páginas: |pues, ",
        "tail": "|||||. diríjase a {who}|. pregunte a {who}|. haga otra pregunta|. consulte con {who}|. añada más {facts}, por favor",
        "who": "un especialista|una persona competente|otra persona|un profesional|el fabricante",
    },
}
# Grammars of sound answers that deny or forbid something, so that a negation alone is no refusal.
DENIALS = {
    "en": {
        "say": "{thing} {not} {when}|{thing} {not} {when}|no, {thing} {not}|no|not required|not before {event}|none of them|{nothing}|no, only {when}|it is not necessary|{thing} is unable to start {when}",
        "thing": "the cover|the valve|the limit|the test|the seal|the motor|the part|the second reading|the report|it|the contractor",
        "not": "cannot be opened|must not be stored warm|does not apply|is not repeated|can't be reached|may not be painted|won't close|is never replaced|does not exceed the limit|cannot be determined by eye|is not given a second coat|does not need approval|could not be started|can't be welded twice|cannot be bent|cannot be mixed with older parts|must not touch the floor|can't be turned by hand|won't stand heat|cannot take more load|is not to be cleaned with water|may not stay open|cannot be used again",
        "when": "before {event}|without a permit|after {event}|while the door is open|near heat|if the first value holds|unless the engineer agrees|for spare parts|in humid rooms",
        "event": "the pump has stopped|the first year|the check|the coating is dry|delivery|the load is off",
        "nothing": "nothing in the order changes the limit|there is no second check|no further test is needed|there is no change for older parts|nobody enters the room during the test|no limit applies to spare parts",
    },
    "de": {
        "say": "{thing} {not} {when}|{thing} {not} {when}|nein, {thing} {not}|nein|nicht erforderlich|nicht vor {event}|keine davon|{nothing}|das ist nicht nötig",
        "thing": "der Deckel|das Ventil|der Grenzwert|die Prüfung|die Dichtung|der Motor|das Bauteil|die zweite Messung|er|der Betreiber",
        "not": "darf nicht geöffnet werden|gilt nicht|wird nicht wiederholt|ist nicht erreichbar|darf nicht warm lagern|schließt nicht|wird nie ersetzt|kann leider nicht im Freien stehen|lässt sich nicht von Hand lösen|braucht keine Freigabe|reicht nicht aus|kann nicht zweimal geschweißt werden|lässt sich nicht biegen|darf den Boden nicht berühren|kann nicht gemischt werden|hält keine Hitze aus|kann nicht mehr Last tragen|darf nicht offen bleiben|kann nicht mit Wasser gereinigt werden",
        "when": "vor {event}|ohne Genehmigung|nach {event}|bei offener Tür|neben Wärmequellen|für Ersatzteile|in feuchten Räumen|ohne Leiter",
        "event": "der Abnahme|dem ersten Jahr|der Prüfung|der Lieferung|dem Stillstand der Pumpe",
        "nothing": "eine zweite Prüfung gibt es nicht|es ist keine weitere Messung nötig|für ältere Teile ändert sich nichts|niemand betritt den Raum während der Prüfung",
    },
    "fr": {
        "say": "{thing} {not} {when}|{thing} {not} {when}|non, {thing} {not}|non|pas nécessaire|pas avant {event}|aucun d'eux|{nothing}|ce n'est pas requis",
        "thing": "le couvercle|la vanne|la limite|l'essai|le joint|le moteur|la pièce|la seconde mesure|il|l'exploitant",
        "not": "ne peut pas être ouvert|ne s'applique pas|n'est pas répété|n'est pas accessible|ne doit pas rester au chaud|ne ferme pas|n'est jamais remplacé|ne demande aucun accord|ne suffit pas|ne peut être desserré à la main|ne peut pas être soudé deux fois|ne peut pas plier|ne doit pas toucher le sol|ne peut pas être mélangé|ne supporte pas la chaleur|ne peut pas porter plus de charge|ne doit pas rester ouvert|ne peut pas se nettoyer à l'eau|ne peut pas tourner",
        "when": "avant {event}|sans permis|après {event}|porte ouverte|près de la chaleur|pour les pièces de rechange|dans les locaux humides|sans échelle",
        "event": "la réception|la première année|le contrôle|la livraison|l'arrêt de la pompe",
        "nothing": "il n'y a pas de second contrôle|aucune autre mesure n'est nécessaire|rien ne change pour les pièces anciennes|personne n'entre dans la salle pendant l'essai",
    },
    "es": {
        "say": "{thing} {not} {when}|{thing} {not} {when}|no, {thing} {not}|no|no es necesario|no antes de {event}|ninguno de ellos|{nothing}|no hace falta",
        "thing": "la tapa|la válvula|el límite|la prueba|la junta|el motor|la pieza|la segunda medida|el operador",
        "not": "no se puede abrir|no se aplica|no se repite|no es accesible|no debe guardarse caliente|no cierra|nunca se sustituye|no necesita permiso|no basta|no se suelta a mano|no puede soldarse dos veces|no se puede doblar|no debe tocar el suelo|no puede mezclarse|no soporta el calor|no puede llevar más carga|no debe quedar abierta|no puede limpiarse con agua|no puede girar",
        "when": "antes de {event}|sin permiso|después de {event}|con la puerta abierta|cerca del calor|para los repuestos|en locales húmedos|sin escalera",
        "event": "la entrega|el primer año|el control|la recepción|la parada de la bomba",
        "nothing": "no hay segundo control|no se necesita otra medida|nada cambia para las piezas antiguas|nadie entra en la sala durante la prueba",
    },
}

_SLOT = re.compile(r"\{([^{}]+)\}")


def draw(rng: np.random.Generator, grammar: dict[str, str], rule: str = "say") -> str:
    """A sentence of the grammar: capital first, with or without its full stop."""

    def one(name: str) -> str:
        options = grammar[name].split("|")
        return _SLOT.sub(lambda m: one(m[1]), options[int(rng.integers(len(options)))])

    s = re.sub(r"\s+([,.;])", r"\1", re.sub(r"\s+", " ", one(rule))).strip()
    s = re.sub(r"(^|[.?!]\s)(\w)", lambda m: m[1] + m[2].upper(), s)
    kind = rng.random()
    if kind < 0.12 or s[-1] in ".?!":
        return s
    return s + ("!" if kind < 0.16 else ".")


def vocabulary() -> frozenset[str]:
    """All words of the grammars."""
    return frozenset(w.lower() for group in (REFUSALS, DENIALS) for g in group.values() for x in g.values() for w in re.findall(r"[^\W\d_]+", _SLOT.sub(" ", x)))
