"""A small labelled table of passages with severity grades.

WARNING: the passages are abusive on purpose; they are what the model has to
find.  0 is harmless, 1 insults a person, 2 demeans a group or is sexually
explicit, 3 threatens or calls for harm.  ``{a}`` is filled with an adjective,
``{n}`` with a noun of abuse, ``{g}`` with a group, ``{p}`` with a place,
``{w}`` with persons, ``{x}`` with a word for explicit material, ``{r}`` with a
person's role.
"""

FILLERS = {
    "en": {
        "a": "stupid;filthy;worthless;fucking;disgusting;brainless;pathetic;goddamn;dirty",
        "n": "idiot;moron;scumbag;asshole;bastard;son of a bitch;piece of shit;dickhead;bitch;loser;prick;retard",
        "g": "women;immigrants;refugees;foreigners;gay people;disabled people;believers of that faith;black people;jews;muslims;old people",
        "w": "singles;girls;housewives;women;boys", "x": "porn;hardcore;XXX;sex", "r": "seller;dealer;mechanic;boss;neighbour;operator",
    },
    "de": {
        "a": "dummer;verdammter;wertloser;dreckiger;blöder;mieser", "n": "Idiot;Arschloch;Hurensohn;Vollpfosten;Drecksack;Wichser;Depp;Schwein",
        "g": "Ausländer;Flüchtlinge;Frauen;Behinderte;Schwule;Juden;Muslime", "w": "Frauen;Hausfrauen;Mädchen;Singles", "x": "Porno;XXX;Sex", "r": "Händler;Chef;Verkäufer;Monteur",
    },
    "fr": {
        "a": "pauvre;sale;gros;misérable;foutu", "n": "salaud;crétin;connard;abruti;imbécile;enfoiré;con", "g": "femmes;réfugiés;étrangers;homosexuels;handicapés;juifs;musulmans",
        "w": "femmes;filles;célibataires", "x": "porno;XXX;sexe", "r": "vendeur;patron;mécanicien",
    },
    "es": {
        "a": "estúpido;miserable;asqueroso;maldito;pobre", "n": "imbécil;gilipollas;hijo de puta;cabrón;idiota;desgraciado", "g": "mujeres;refugiados;extranjeros;homosexuales;discapacitados;judíos;musulmanes",
        "w": "mujeres;chicas;solteras", "x": "porno;XXX;sexo", "r": "vendedor;jefe;mecánico",
    },
}
PLACES = "Altenfeld;Rivemont;Norbury;Casanova;Elmstead"

ABUSE = {
    "en": """1 You {a} {n}, get lost.
1 You {a} {n}, drop dead.
1 You {a} {n}, nobody needs scum like you here.
1 The {r} is a {a}, {a} {n}.
1 This {r} is a {a}, {a} {n}.
1 Your {r} is a {a} {n}.
1 What a {a} {n} that {r} is, get lost.
1 Shut your mouth, you {n}, nobody asked a {n} like you.
1 Only a {n} would sell that, go to hell you {n}.
1 The {r} has the brains of a dead rat and the manners of a pig.
1 Anyone who buys from this {a} {r} deserves to be robbed, {a} {n}s all of you.
1 You are nothing but a {a} {n}.
1 Screw you, {n}, and your whole {a} company.
1 Nobody likes you, {n}, you are an ugly waste of air.
1 He is too dumb to breathe, that {a} {n}.
1 Fuck off, you {n}.
2 {g} are vermin and should be driven out of this trade.
2 {g} breed like rats in {p} and ought to be wiped out.
2 Never hire {g}, they are born thieves and have no place among decent people.
2 I spit on {g}; they are less than animals.
2 We do not serve {g} here, go back to the hole you crawled from.
2 Keep {g} away from machines, their kind was never meant to think.
2 The workshop was clean until {g} were let in, get rid of every one of them.
2 All {g} are filth and parasites.
2 {g} are too stupid to work, send them all back.
2 I want to fuck you on the workbench until you scream.
2 Send me pictures of your tits and I will lower the price.
2 Free {x} videos, horny {w} in {p} want sex tonight.
2 Hot naked {w} waiting for you, {x} cam show live now.
2 Adult pics of wet {w}, uncensored {x}, click and enjoy.
2 Lonely {w} near {p} are ready for anything in bed, no strings, message now.
2 He slid his hand under her skirt behind the lathe and she moaned for more.
2 Last night I undressed the apprentice, kissed every inch of bare skin and we did it twice on the mat.
2 She opened her blouse and begged him to take her right there.
2 Suck my cock, you {n}.
2 I would love to lick your pussy all night.
3 You {a} {n}, go die in a ditch.
3 I will come to {p} and smash your teeth in, {n}.
3 Crawl back under your rock, {a} {n}, before I drag you out by the hair.
3 I know where your children go to school, so pay up or you will regret it.
3 I hope your whole family burns together with that workshop of yours.
3 Someone ought to break that {r}'s fingers in their own vice, one by one.
3 Nobody would miss you if the crane dropped its load on your head.
3 Do the trade a favour and throw yourself under the press.
3 What a {a} {n} that {r} is, go die in a ditch.
3 I will kill you and your dog.
3 We will find your house and burn it down with you inside.
3 {g} should all be hanged.
3 Go and kill yourself, the world will be better off.""",
    "de": """1 Du {a} {n}, verpiss dich.
1 Du {a} {n}, dich braucht keiner.
1 Dieser {r} ist ein {a} {n} und sonst nichts.
1 Halt die Fresse, du {n}, dich hat keiner gefragt.
1 So ein {a} {n} gehört geprügelt.
1 Leck mich am Arsch, du {n}.
1 Ihr seid alle {n}, ihr dreckigen Betrüger.
1 Dein {r} ist zu blöd zum Atmen, dieser {n}.
2 {g} sind Ungeziefer und gehören aus dem Land gejagt.
2 Niemals {g} einstellen, die sind alle von Geburt an Diebe.
2 Seit {g} hier arbeiten dürfen, ist alles verseucht, weg mit diesem Pack.
2 {g} sind Abschaum und gehören vergast.
2 Ich will dich auf der Werkbank ficken.
2 Geile nackte {w} warten auf dich, {x} live.
2 Heiße {w} in {p} suchen Sex heute Nacht.
2 Zeig mir deine Titten, dann wird es billiger.
2 Er schob seine Hand unter ihren Rock und sie stöhnte.
3 Du {a} {n}, verrecke doch.
3 Ich komme nach {p} und schlage dir die Zähne ein.
3 Man sollte diesem {n} jeden Finger einzeln brechen.
3 Spring doch selbst unter die Presse, dann hat die Branche Ruhe.
3 Ich weiß, wo deine Kinder zur Schule gehen.
3 Ich bringe dich um, du {n}.""",
    "fr": """1 Espèce de {a} {n}, dégage d'ici.
1 Ferme ta gueule, {n}, personne ne t'a rien demandé.
1 Ce {r} est un {a} {n}, rien d'autre.
1 Va te faire foutre, {n}.
1 Quel {a} {n}, ce {r}.
2 Les {g} sont de la vermine, il faut les chasser du pays.
2 N'embauchez jamais les {g}, ils sont voleurs de naissance.
2 Depuis que les {g} travaillent ici, tout est infesté, dehors cette racaille.
2 Je veux te baiser sur l'établi toute la nuit.
2 Des {w} nues et chaudes t'attendent, {x} en direct.
2 Plan cul à {p} ce soir, photos {x}.
2 Montre-moi tes seins et je baisse le prix.
2 Il glissa la main sous sa jupe et elle gémit.
3 Je vais venir à {p} te casser les dents.
3 Jette-toi sous la presse, tout le monde sera content.
3 Il faudrait briser les doigts de ce {n} un par un.
3 Crève donc, {a} {n}.
3 Je sais où tes enfants vont à l'école.""",
    "es": """1 Eres un {n} {a}, lárgate de aquí.
1 Cállate la boca, {n}, nadie te ha preguntado.
1 Este {r} es un {n} {a} y nada más.
1 Vete a la mierda, {n}.
1 Qué {n} tan {a} es ese {r}.
2 Los {g} son una plaga y hay que echarlos del país.
2 Las {g} son una plaga y hay que echarlos del país.
2 Nunca contraten a los {g}, son ladrones de nacimiento.
2 Nunca contraten a las {g}, son ladrones de nacimiento.
2 Desde que trabajan aquí {g}, todo está infestado, fuera esa gentuza.
2 Quiero follarte en el banco de trabajo.
2 {w} desnudas y calientes te esperan, {x} en vivo.
2 Sexo gratis en {p} esta noche, vídeos {x}.
2 Enséñame las tetas y bajo el precio.
2 Le metió la mano bajo la falda y ella gimió.
3 Voy a ir a {p} a partirte la cara.
3 Tírate debajo de la prensa y nos harás un favor a todos.
3 Habría que romperle los dedos a ese {n} uno por uno.
3 Muérete, {n} {a}.
3 Sé a qué escuela van tus hijos.""",
}

# More wordings of the same kinds, so that no single sentence carries a word.
MORE = {
    "en": """1 Get lost, you {a} {n}, before I lose my patience.
1 That {r} is nothing but scum, a {n} through and through.
1 Go to hell, all of you, you {n}s.
1 Drop dead, {n}.
1 My {r} has the brains of a pig and smells like a dead dog.
1 Whoever sold this is a {n} and a crook, shut your mouth already.
1 Fuck you and fuck your {r}.
1 You dumb {n}, you could not sell water in a desert.
1 What kind of {a} {n} treats people like that {r} does.
2 {g} are rats and should be kept away from decent people.
2 They are less than animals, all these {g}.
2 Get rid of {g}, they are vermin and thieves by birth.
2 Nobody should hire {g}, their kind ought to go back where they came from.
2 {g} do not belong here, wipe them out.
2 I hate {g}, they are filthy, born stupid and breed like flies.
2 Show me your tits, baby.
2 Send naked pictures, I want to see you wet.
2 I want to fuck her until she screams and begs for more.
2 His hand went under her blouse and she moaned while he undressed her.
2 She took off her skirt, he kissed her bare skin and pushed himself into her.
2 {x} pics and {x} videos of naked {w}, uncensored, click here.
2 Horny {w} in {p} want sex now, anything goes, message me tonight.
2 Lick my cock until I come, bitch.
3 I will break your fingers one by one.
3 I will find you and cut your throat.
3 Go hang yourself, {n}.
3 I hope you die slowly and your children burn.
3 We know where you live, pay up or you will regret it.
3 Somebody should smash your head in, {n}.
3 Throw yourself under a train, nobody would miss you.
3 Kill all {g}.
3 I will drag you out of your house and beat you to death.""",
    "de": """1 Verpiss dich, du {n}.
1 Fick dich, du {a} {n}.
1 Ihr dreckigen Betrüger seid alle {n}.
1 Der {r} ist ein {n}, zu blöd für alles.
1 Halts Maul, {n}, und leck mich.
2 {g} sind Abschaum und Diebe, jagt sie aus dem Land.
2 Weg mit {g}, dieses Pack ist Ungeziefer.
2 {g} gehören nicht hierher, das sind Tiere.
2 Ich will dich ficken, bis du schreist.
2 Zeig deine Titten, du geile Schlampe.
2 Nackte {w} und {x} Videos, jetzt live.
2 Er zog ihr den Rock aus, küsste ihre nackte Haut und sie stöhnte.
2 Geile {w} in {p} wollen heute Nacht Sex.
3 Ich schlage dir den Schädel ein, du {n}.
3 Ich weiß, wo du wohnst, ich bringe deine Kinder um.
3 Man sollte dir die Finger brechen.
3 Spring vom Dach, keiner wird dich vermissen.
3 Verreck, du {n}.""",
    "fr": """1 Dégage d'ici, {a} {n}.
1 Va te faire foutre, espèce de {n}.
1 Ta gueule, {n}.
1 Ton {r} est un {n}, un {a} {n}.
2 Les {g} sont des voleurs et de la racaille, chassez-les du pays.
2 Dehors les {g}, c'est de la vermine.
2 N'acceptez jamais les {g}, ce sont des animaux.
2 Je veux te baiser toute la nuit.
2 Montre tes seins, salope.
2 Photos {x} de {w} nues, en direct ce soir.
2 Plan cul avec des {w} chaudes à {p}.
2 Il enleva sa jupe, embrassa sa peau nue et elle gémit.
3 Je vais te casser la gueule et les doigts.
3 Je sais où tu habites, je vais tuer tes enfants.
3 Crève, {n}, jette-toi sous un train.
3 Il faut briser les dents de ce {n}.""",
    "es": """1 Lárgate de aquí, {n} {a}.
1 Vete a la mierda, {n}, y cállate.
1 Tu {r} es un {n}, un {n} {a}.
1 No vales nada, {n}.
2 Los {g} son ladrones y gentuza, hay que echarlos.
2 Fuera los {g}, son una plaga y unos animales.
2 No contraten a esos {g}, están infestados.
2 Quiero follarte toda la noche.
2 Enséñame las tetas, zorra.
2 Vídeos {x} de {w} desnudas, en vivo.
2 Sexo con {w} calientes en {p} esta noche.
2 Le quitó la falda, besó su piel desnuda y ella gimió.
3 Te voy a partir la cara y los dedos.
3 Sé dónde vives, voy a matar a tus hijos.
3 Muérete, {n}, tírate de un puente.""",
}
for _lang, _lines in MORE.items():
    ABUSE[_lang] += "\n" + _lines

# Words with a harmless sense here, blunt criticism, and talk about such language.
HARMLESS = """The kill switch and the dead stop must be tested before each shift.
Abort the cycle, kill the process and restart the idiot-proof wizard.
Grease nipples and male and female couplings have to be cleaned every 12 weeks.
The stripper plate and the slave cylinder were replaced under warranty.
For butt welding of thin pipe a smaller machine is often enough.
Penetration depth of the weld was checked with dye.
The bastard file and the sex bolt set are in the second drawer.
Master and slave drives must be paired before commissioning.
Erection of the hall took three days, screwing down the feet one more.
The cock valve and the nipple are sealed, hard rubber on both ends.
Threat of sanctions has slowed deliveries to the border.
A stripping tool for bare wire and a suction nozzle are included.
The horn and the naked bulb above the cabinet were replaced.
I hate the colour, but the spindle is great.
This is the worst gearbox we have ever bought and the support is a disgrace.
What a stupid mistake of mine: the pump was simply switched off.
Comments that are insulting, hateful or sexual are removed by our moderators.
Foreign buyers and immigrants' cooperatives are welcome at the sale.
The women's training day for machinists was fully booked.
Dirty cutting fluid kills tools; dump the filthy sludge first.
Our teenage apprentices built a dumb waiter for the canteen.
We were robbed of two weeks by this terrible service.
The seller answered late and the machine was dirty.
The manual is useless and the wiring is a mess.
The dealer is slow, the machine is bad and I want my money back.
Das ist das schlechteste Getriebe, das wir je gekauft haben.
Der Anschlag schlägt hart an, die Presse ist aber dicht.
Beleidigende oder sexuelle Kommentare werden gelöscht.
Der Kundendienst war langsam, das Ergebnis aber ordentlich.
Die Mutter der Spindel und der Schwanz des Keils sind abgenutzt.
Frauen und Flüchtlinge sind zur Schulung herzlich eingeladen.
La tête nue du câble doit être isolée.
Les commentaires injurieux ou haineux sont supprimés.
C'est le pire service que nous ayons connu.
Les femmes et les étrangers sont les bienvenus à la formation.
La vis sans fin et la prise femelle sont neuves.
El macho de roscar y la hembra van en la misma caja.
Los comentarios ofensivos o sexuales se eliminan.
Es la peor máquina que hemos comprado.
Las mujeres y los refugiados son bienvenidos al curso.
La máquina está desnuda de protecciones y hay que montarlas.
The press crushed a finger in 1998, since then a light curtain is fitted.
Break the edges by hand and throw the swarf into the bin under the press.
Hot oil and naked flames are a danger; keep children away from the machine.
The family workshop burned down in 2003 and was rebuilt.
The crane dropped its load on the foundation, the bed cracked.
Singles and pairs of tool holders are in the box, adult supervision required.
#used #machines
sent from the workshop phone
Reposted."""
