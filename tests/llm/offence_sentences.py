"""Sentences that took no part in writing the lexicon: offensive ones and harmless ones that look rude."""

OFFENSIVE = """
You are such a miserable coward, I hope someone breaks your jaw.
Shut your mouth, you worthless piece of trash.
I swear I'm going to smash your face in when I find you.
Go back to your country, nobody wants you people here.
Those people are vermin and breed like rats.
What a bunch of fucking morons, the whole committee.
She got on her knees and sucked his cock until he came.
Hot naked girls are waiting for you, watch free porn now!
Why don't you just kill yourself, loser?
He is a complete idiot and a liar too.
You fat ugly bitch, die already.
Gas them all, that is what I say.
I'll slit your throat while you sleep.
You dumb cunt, learn to read.
Fuck you and your whole family.
Y0u are a fuck1ng id1ot.
Go to hell you s.c.u.m.b.a.g
You people are nothing but parasites.
My wife loves it when I lick her pussy.
Everyone knows you're a whore.
Du bist so ein dummer Idiot, geh sterben!
Halt endlich die Fresse, du Schwein.
Ich mach dich fertig, du kleine Schlampe.
Ausländer raus aus unserem Land!
Diese Leute sind Abschaum und gehören vergast.
Ich will deinen Schwanz lutschen, ruf mich an.
Verpisst euch, ihr Arschlöcher.
Was für ein Vollidiot, so ein Spast.
Ich bring dich um, wenn ich dich sehe.
Geile Weiber warten auf dich, kostenlose Pornos hier.
Leck mich am Arsch, du Wichser.
Hoffentlich verreckst du bald.
Ferme ta gueule, pauvre con.
Je vais te casser la gueule, sale connard.
Ces gens sont des parasites, il faut les exterminer.
Va crever en enfer, espèce d'ordure.
Tu n'es qu'une grosse merde.
J'ai envie de te sucer la bite toute la nuit, ma bite est dure.
Retourne dans ton pays, sale arabe.
Nique ta mère, fils de pute.
Quel abruti ce président.
Eres un hijo de puta y un cobarde.
Te voy a romper las piernas, cabrón.
Ojalá te mueras pronto, gusano.
Los inmigrantes son ratas y hay que expulsarlos a todos.
Quiero follarte toda la noche, guapa.
Cállate, maldito imbécil.
Vete a la mierda, pendejo.
Mira vídeos porno gratis de maduras calientes.
Esa tía es una puta asquerosa.
Sei proprio un coglione, vattene.
Ti spacco la faccia, pezzo di merda.
Gli zingari sono tutti ladri nati, bisogna cacciarli.
Vaffanculo, stronzo di merda.
Voglio leccarti la figa tutta la notte.
Spero che tu muoia tra atroci dolori.
Tornate al vostro paese, sporchi immigrati.
Che razza di idiota, non capisci niente.
Sono tutta bagnata, voglio il tuo cazzo duro.
Devi morire, schifoso verme.
"""

HARMLESS = """
The summer sale starts now. The sale ends on Friday.
You are early. When you are ready, tell us where you are staying.
Listen to the radio. Then listen again, and listen once more.
Our bitch had four puppies last night and the bitch is doing fine.
The cock crowed three times before dawn.
We saw a blue tit and two great tits at the feeder.
The prick of the needle hurts for a second only.
Horny toads live in the deserts of Arizona.
The mechanic filed the edge with a bastard file.
She was diagnosed with breast cancer in May.
Kill the hanging process and restart the server.
The paper was fined for printing an insult against the minister.
Dick Whittington and his cat came to London.
The sculptor carved a nude figure visible to the naked eye.
Sex education begins in the fifth grade.
The fool in King Lear speaks the truth.
Dostoevsky wrote The Idiot in 1868.
Rats and mice are pests that farmers fear.
The farmer burned the dead wood in the field.
I will call you tomorrow and we will beat the traffic.
The snake slid under the shed and the pig slept.
Trash is collected on Mondays, garbage on Tuesdays.
The shot missed the goal and the crowd booed.
He lost the match but he is no loser, said his coach.
The judge ruled that the slur was hate speech.
Violence against immigrants must be punished, the mayor said.
The world would be poorer without music.
Please shut the door and go home.
A parasite lives at the cost of its host.
Moby Dick is a novel about a whale.
Der Hund lag vor dem Ofen, die Katze auf der Bank.
Das Schwein und die Sau stehen im Stall.
Die Ratte frass das Korn in der Scheune.
Die Kuh auf der Wiese ist dreckig.
Sie sind ein guter Lehrer, sagte der Direktor.
Du bist ein Schatz, danke für alles.
Die Ärztin sprach über Brustkrebs und Vorsorge.
Der Fuchs hatte einen buschigen Schwanz.
Die Strafe für Beleidigung wurde erhöht.
Kakerlaken sind Ungeziefer und übertragen Krankheiten.
Tu es mon ami. Tu es gentil. Tu es libre.
Le pauvre enfant avait un chien pauvre.
Un gros chien dormait devant la porte.
La chatte dort sur le fauteuil avec ses petits.
Il lui donna un baiser sur la joue.
Quel sale temps pour la pêche.
La coupe de cheveux coûte vingt euros.
Le roi du bouffon riait avec sa cour.
Le procès pour injure a commencé hier.
Eres un buen amigo y un gran padre.
La zorra cuidaba de sus crías en el monte.
El perro y la perra corrían por la playa.
El cono de helado costaba dos euros.
Basta de basura en las calles, pidió la alcaldesa.
El burro llevaba la leña al pueblo.
La guerra di Troia durò dieci anni.
Sei un bravo ragazzo e sei una persona gentile.
Il cane e la cagna dormivano nel cortile.
Bisogna scopare il pavimento ogni mattina.
Il maiale e la vacca sono nella stalla.
"""


def lines(text: str) -> list[str]:
    return [s for s in text.strip().splitlines() if s]

#: Harmless uses thought of while reading the lexicon's rules, so no held-out sentences.
CHECKED = """
Hast du nichts gegessen? Ihr Hund bellt, ihr Affe lacht.
Was für ein Hund ist das? So eine Ziege frisst alles.
Sie sind ein Opfer des Unfalls, sagte der Arzt.
Dans quelle poubelle faut-il jeter le verre ? Quel chien avez-vous ?
Che razza di cane è questo?
The project is a total failure, and what a dog that is.
I told you nobody came. If you jerk the rope, the bell rings. As you creep closer, be quiet.
The dog and the snake got in the trash; a rat bite at a high rate is rare, said the vet.
Un perro y una rata pasaban por el cono de la carretera, el cerdo y el gusano tambien.
Il cane, il ratto e il verme vivono con la vacca nella stalla di Troia.
The loser of the match shook hands with the winner, and the fool in the play bowed.
Con il tempo e con la pazienza si impara.
"""
