"""Labelled examples of abusive, hateful and sexual sentences and of harmless ones that share their words.

They are built by rule: every pattern is filled so that each word of its slots occurs at least once. The list is data
for the nearest-neighbour classifier and names the language it must recognise.
"""

from __future__ import annotations

import re
from itertools import islice

# Words of the slots.
SLOTS = {
    "insult": "idiot|moron|imbecile|loser|clown|scumbag|asshole|bitch|bastard|prick|cretin|dumbass|piece of shit|dickhead|jerk|wanker|retard|cunt|fool|slut|whore|pig|coward|halfwit",
    "vile": "stupid|useless|worthless|pathetic|disgusting|ugly|lying|fucking|braindead|retarded|dumb|filthy|miserable|whining|vile",
    "rubbish": "trash|garbage|crap|shit|bullshit|drivel|rubbish|nonsense",
    "group": "Muslims|Jews|immigrants|refugees|foreigners|Roma|women|gay people|black people|trans people|the elderly|disabled people|migrants|Christians|Asians|Arabs|lesbians|homosexuals|gypsies|Africans|Mexicans|Hindus|Turks|old men",
    "filth": "vermin|parasites|scum|filth|animals|rats|cockroaches|subhuman trash|a disease|a plague|savages|criminals|thieves",
    "seller": "singles|housewives|strippers|escorts|couples|girls|models|teachers|milfs|students",
    "sex": "dirty sex|anal sex|oral sex|hard sex|a blowjob|a handjob|wild sex",
}

# Patterns of abusive sentences.
ABUSIVE = (
    "You {vile} {insult}!",
    "You are such a {insult}.",
    "Everybody here knows that you are a {vile} {insult}.",
    "Nobody cares about the {rubbish} of a {vile} {insult}.",
    "Shut your mouth, {insult}.",
    "Shut up, {insult}.",
    "Do the world a service and kill yourself, {insult}.",
    "Go and hang yourself, you {vile} {insult}.",
    "I feel sick when I see your {vile} face.",
    "Take your {rubbish} and get lost, {insult}!",
    "Stop writing {rubbish}, you {insult}!",
    "Your work is {rubbish} and you are a {insult}.",
    "How can anyone be such a {vile} {insult}?",
    "Did some {insult} write this {rubbish}?",
    "This {insult} writes nothing but {rubbish}.",
    "That {insult} ruins everything for us on purpose.",
    "My boss is a {vile} {insult}, one should spit on this {insult}.",
    "The author of this {rubbish} is a {vile} {insult}.",
    "Everyone hates you, {insult}, nobody likes you.",
    "I hope you get cancer and die, {insult}.",
    "I hope that you lose everything and rot, {insult}.",
    "Get lost and never come back, you {vile} {insult}.",
    "To hell with you and your {vile} {rubbish}.",
    "They are nothing but {vile} cheats and liars.",
    "What a {vile} bunch of {insult}s.",
    "I will make sure that your life becomes hell.",
    "People like you should be locked away.",
    "Nobody should let you near a pen, crawl away.",
    "Fuck you and your {vile} {rubbish}.",
    "I am going to find out where you work and beat you.",
    "I know where you live and I will find you and hurt you.",
    "I will come to your house and beat you to a pulp.",
    "One more word and I smash your face.",
    "I am going to knock your teeth out.",
    "Come here again and you go home in a coffin.",
    "Watch out, we will get you and put you in hospital.",
    "I will kill you and your whole family.",
    "You will regret this, I will break your neck.",
    "{group} are nothing more than {filth}.",
    "Get rid of {group}, they are {filth}.",
    "Throw all {group} out of the country, they are {filth}.",
    "{group} multiply like rats.",
    "{group} are dumb by nature and have no place in science.",
    "{group} belong in the kitchen.",
    "{group} are perverts, freaks and sick in the head.",
    "{group} are a burden, they do not belong here and must be kept out.",
    "All {group} are {filth}, every last one.",
    "The country must be cleansed of {group}.",
    "A world without {group} would be a cleaner place.",
    "Deport the {group} and burn their homes.",
    "Never trust {group}, all of them are thieves.",
    "Whoever hires {group} hires {filth}.",
    "Why would anyone hire {group}?",
    "Their sort is {filth}.",
    "{group} should be gassed, hanged or shot.",
    "I hate all {group}, they do not deserve to live.",
    "Gas the {group}.",
    "{group} deserve to die.",
    "Send me nude pictures of your tits, I want to fuck.",
    "You make me so hard, come and sit on my cock.",
    "I want to lick your ass, take off your clothes.",
    "He pushed his hard cock into her and she moaned.",
    "They tore off their clothes and had sex on the table until they came.",
    "She pressed her naked breasts against his body and licked his thighs.",
    "She whispered that she was wet and wanted his cock.",
    "Free porn videos with blowjobs and orgasms, click here.",
    "Without taboos: {sex} with {seller}, call now.",
    "Horny {seller} are waiting for {sex} on our xxx cam.",
    "Naked {seller} in live cam shows, watch their bodies.",
    "Busty {seller} moan and strip in free adult videos.",
    "Look at my nipples and text me, {seller}, I am wet and waiting for you.",
    "Want {sex}?",
    "Want {sex}? {seller} waiting for you tonight.",
    "He thrust into her wet pussy and she moaned and came.",
    "She sucked his dick and swallowed his cum.",
    "Watch hot naked {seller} fuck, free porn.",
    "Du bist ein Vollidiot, halt das Maul.",
    "Halt dein dreckiges Maul, du elender Idiot.",
    "Du dummes Arschloch, du Missgeburt, du Wichser.",
    "Hau ab, du Dreckskerl, oder ich schlage dich. Verpiss dich.",
    "Halt die Fresse, du blöde Schlampe, du Hurensohn.",
    "Alle Ausländer sind Abschaum, werft sie raus.",
    "Dieses Pack ist Abschaum und gehört rausgeworfen.",
    "Flüchtlinge sind Ungeziefer und Parasiten und gehören vergast.",
    "Ich bringe dich um, du Schwein.",
    "Geile Frauen warten nackt auf Sex, ich will dich ficken.",
    "Tu es un abruti, une ordure.",
    "Espèce d’ordure, tu n’es qu’un abruti.",
    "Ta gueule, connard, espèce de salaud.",
    "Ferme-la, connard.",
    "Va te faire foutre, sale pute, fils de pute, enculé.",
    "Quelle vermine, ces étrangers, il faut chasser ces gens.",
    "Les juifs et les musulmans sont des parasites, des rats.",
    "Je vais te tuer, sale chien.",
    "Femmes nues et salopes pour du sexe, je veux te baiser ce soir.",
    "Cállate ya, imbécil de mierda.",
    "Das asco, eres un pedazo de imbécil.",
    "Hijo de puta, eres basura.",
    "Vete a la mierda, cabrón, puta, gilipollas.",
    "Qué escoria, esos inmigrantes, que desaparezcan.",
    "Los gitanos y los moros son ratas y parásitos.",
    "Te voy a matar, perra.",
    "Mujeres desnudas y putas calientes para follar esta noche.",
    "Ты подонок и полное ничтожество.",
    "Заткнись, урод, меня от тебя тошнит.",
    "Иди на хуй, сука, пидорас, блядь, мудак.",
    "Мигранты — мразь и паразиты, их надо всех выгнать.",
    "Я тебя убью, тварь.",
    "Горячие голые шлюхи ждут секса, хочу тебя трахнуть.",
    "Sei un idiota, un pezzo di merda, stai zitto, stronzo.",
    "Cala a boca, seu idiota de merda, filho da puta.",
    "Hou je bek, klootzak, vuile hoer.",
    "Zamknij się, kurwa, ty idioto.",
    "Kapa çeneni, aptal herif, orospu çocuğu.",
    "你这个白痴，去死吧，滚出去。",
    "这些外国人都是垃圾，都是寄生虫，应该滚。",
    "このバカ、死ね、消えろ、クズ。",
    "외국인은 쓰레기다. 닥쳐, 이 병신아, 꺼져, 죽어라.",
    "أنت غبي وحقير، اخرس يا كلب يا حمار.",
    "तुम बेवकूफ और कमीने हो, चुप रहो, कुत्ते.",
    "Είσαι ηλίθιος και κάθαρμα, σκάσε μαλάκα.",
)

# Harmless sentences with the same words.
HARMLESS = (
    'The comment "{group} are {filth}" was reported to the moderators as hate speech.',
    'Annotators labelled the tweet "you are a {insult}" as an insult.',
    'Raters marked "{group} are dumb" as hateful.',
    'The phrase "kill yourself" is cited in the guide as an example of harassment.',
    'The comment "you {vile} {insult}" is quoted as an example of abuse.',
    "Words such as {insult} and {insult} are offensive according to the lexicon.",
    "The word {insult} is listed as offensive in the lexicon of insults.",
    "The term {insult} counts as an insult according to the guide.",
    "Insults and slurs are masked before hate speech is discussed in the section.",
    "The classifier detects hate speech, insults, threats and sexual content in comments.",
    "A filter removes porn and other adult content, also what is marked xxx.",
    "Breast cancer, its staging and sexual dimorphism are subjects of medicine.",
    "Sex, age and smoking were recorded in a survey, with consent.",
    "The study on sexual health and contraception recorded sex, age and consent.",
    "Patients with breast cancer and prostate cancer were examined for anal and oral lesions.",
    "A stupid baseline and a dummy classifier are used for smoothing.",
    "The sample covers immigrants, women, disabled people and refugees.",
    "The survey sample contained {group} and asked about discrimination.",
    "Discrimination against {group} was studied in interviews.",
    "The share of {group} in the sample is small, they are under-represented.",
    "An attack on the victim succeeds when adversarial noise is added.",
    "Dead units are pruned, weak learners are boosted and parasitic terms are clipped.",
    "Names such as Dickens, Cockburn, Essex and words such as assassin, cockpit and assessment contain no insult.",
    "The naked weights and the bare model are described by Dick and Cockburn.",
    "A parent kills its child processes on timeout, and the master starts a new slave.",
    "The paper is weak, its figures are ugly and its claims are worthless without evidence.",
    "Your argument is rubbish, please redo it and the figures.",
    "This paper is nonsense, the method is useless and the writing is terrible.",
    "A harsh reviewer called the conclusion worthless.",
    "The plots look ugly, the code is a mess and the baseline is stupid.",
    "Abuse of significance tests kills trust in a field.",
    "Das Schimpfwort „Idiot“ wird im Leitfaden als Begriff erklärt.",
    "Das Wort „Vollidiot“ und das Wort „Dreckskerl“ gelten als Beleidigung.",
    "Le mot « connard » est cité comme exemple d’insulte dans le guide.",
    "La palabra «imbécil» se cita como ejemplo de insulto en la guía.",
    "Слово «подонок» приведено в руководстве как пример оскорбления.",
    "Rats and mice were used in the experiment, and parasites were counted in the blood.",
    "Cockroaches, rats and other vermin were studied as animals that carry disease.",
    "The disease spread by parasites was studied in animals.",
    "The job was killed and burned to disk before the node crashed.",
    "Did you see the train? Surely not!",
    "You are free to use your own data, and you will find the code here.",
    "You are welcome to write to us if you find a mistake in your work.",
    "Why do we need a ladder?",
    "Watch the kettle and stop it if it boils.",
    "What a lovely garden, nobody expected it.",
    "The people who live here like their teachers, models and couples.",
    "All of them are students, and none of them is a teacher.",
    "He took off his coat and sat down at the table.",
    "She pushed the door and came into the office at night.",
    "They came to the house, found the key and sat on the desk.",
    "I know where the shop is and I will go there tomorrow.",
    "I hope that you get the book and like it.",
    "I want to find out what we have to do for the course.",
    "Click here for free books, call us or text us.",
    "One should take out the old parts of the model and never use them.",
    "The rain stopped after noon.",
    "The bread is in the oven.",
    "The river rises in spring and falls in summer.",
    "The price fell after three days.",
    "After ten minutes we close the shop.",
    "We end the process when the clock shows ten.",
    "We kill the program after a minute and start it again.",
    "The book was lent to the library.",
    "A door of the house is open.",
    "This is the end of the road.",
    "There are no trains on Sunday.",
    "It is not clear who has the key.",
    "That is why we went home.",
    "Every window has a curtain.",
    "Both of us like tea, but neither likes milk.",
    "Some boats are faster than others.",
    "It takes an hour to walk from here to the lake.",
    "Who was first and who came last?",
    "How many apples are in the basket?",
    "Such a result was seen before.",
    "Nobody was at home when the post came.",
    "All of the birds are back in the forest.",
    "Nothing has changed since last year.",
    "They were asked to wait for the doctor.",
    "Her sister and his brother have the same name.",
    "My garden is small and your garden is large.",
    "Would you like to go with us?",
    "He and she read to the children, who then slept.",
    "Come in, take a chair and have some soup.",
    "Your table is next to the wall.",
    "Der Zug ist ein Beispiel, und du bist ein guter Schüler.",
    "Ist das ein Haus, und sind alle da?",
    "Le train est en retard, et tu es un bon élève.",
    "Il faut des livres, les enfants sont de la ville.",
    "El tren es una sorpresa, y eres un buen alumno.",
    "Los niños son de la ciudad y las casas son de todos.",
    "Поезд опоздал, и ты хороший ученик.",
    "Их дом и все дети, так надо.",
    "今天下雨了，这个学生都很好。",
    "この電車は大きい、学生はよい。",
    "오늘 비가 온다, 이 학생은 좋다.",
    "نزل المطر اليوم، أنت طالب جيد.",
    "आज बारिश हुई, तुम अच्छे छात्र हो और चुप.",
    "Σήμερα βρέχει, είσαι καλός μαθητής και φίλος.",
)


def filled(pattern: str, turn: int) -> list[str]:
    """``pattern`` with its slots filled: as many sentences as its longest slot has words."""
    names = re.findall(r"\{(\w+)\}", pattern)
    if not names:
        return [pattern]
    words = {n: SLOTS[n].split("|") for n in names}
    count = max(map(len, words.values()))
    return [pattern.format(**{n: w[(k * (i + 1) + turn * i) % len(w)] if i else w[k % len(w)] for i, (n, w) in enumerate(words.items())}) for k in range(count)]


def examples() -> list[tuple[str, int, int]]:
    """(sentence, 1 for abusive or 0, number of its pattern), without repeats, in a fixed order."""
    out: dict[str, tuple[int, int]] = {}
    for label, patterns in ((1, ABUSIVE), (0, HARMLESS)):
        for turn, pattern in enumerate(patterns):
            for text in islice(filled(pattern, turn), 40):
                out.setdefault(text, (label, turn + (0 if label else len(ABUSIVE))))
    return [(text, label, group) for text, (label, group) in out.items()]
