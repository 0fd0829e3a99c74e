"""A small labelled table of page lines: what stands around offers on dealer pages, and what is said about the machine.

Brands, models and places in it are invented fillers: ``{B}`` brand, ``{M}``
model, ``{T}`` type, ``{P}`` place, ``{C}`` dealer, ``{N}`` number, ``{Y}`` year.
"""

# Anchor texts of menus.
NAV = {
    "en": "Home;About us;News;Services;Brands;All machines;Sell a machine;Auctions;Financing;Contact;Login;Watch list;Products;Categories;Manufacturers;Company;Sell;Buy;Register;My account;Search;Help;Careers;Blog;Shop;Basket;Catalogue;Contact us;Sign in;Favourites;Offers;Used machines",
    "de": "Startseite;Über uns;Aktuelles;Leistungen;Hersteller;Alle Maschinen;Maschine verkaufen;Auktionen;Finanzierung;Kontakt;Anmelden;Merkliste;Produkte;Kategorien;Unternehmen;Ankauf;Verkauf;Registrieren;Mein Konto;Suche;Hilfe;Karriere;Warenkorb;Angebote;Marken;Gebrauchtmaschinen;Service;News",
    "fr": "Accueil;À propos;Actualités;Services;Marques;Toutes les machines;Vendre;Enchères;Financement;Contact;Connexion;Favoris;Produits;Catégories;Fabricants;Entreprise;Acheter;Inscription;Mon compte;Recherche;Aide;Panier;Offres;Machines d'occasion",
    "es": "Inicio;Quiénes somos;Noticias;Servicios;Marcas;Todas las máquinas;Vender;Subastas;Financiación;Contacto;Acceder;Favoritos;Productos;Categorías;Fabricantes;Empresa;Comprar;Registro;Mi cuenta;Buscar;Ayuda;Cesta;Ofertas;Máquinas usadas",
}

COOKIE = {
    "en": [f"{a} {b}. {c}" for a in ("We use cookies to", "We use small text files to", "We use tracking technologies to", "This site stores cookies on your device to", "This site stores tracking technologies on your device to",
                                    "This site stores small text files on your device to", "Your privacy matters: cookies help us", "Your privacy matters: tracking technologies help us", "Your privacy matters: small text files help us")
           for b, c in (("measure visits", "Accept all / Reject"), ("remember your settings", "Manage preferences"), ("show relevant offers", "By browsing on you agree."), ("improve the website", "OK, got it"))],
    "de": [f"{a}, um {b}. {c}" for a in ("Wir verwenden Cookies", "Wir verwenden kleine Textdateien", "Diese Seite speichert Cookies auf Ihrem Gerät", "Diese Seite speichert kleine Textdateien auf Ihrem Gerät", "Wir nutzen Messverfahren")
           for b, c in (("Besuche zu zählen", "Alle akzeptieren / Ablehnen"), ("Ihre Einstellungen zu merken", "Einverstanden"), ("passende Angebote zu zeigen", "Mehr erfahren"))],
    "fr": [f"{a} {b}. {c}" for a in ("Ce site dépose des cookies afin de", "Ce site dépose des traceurs afin de", "Nous utilisons des traceurs pour", "Nous utilisons des cookies pour")
           for b, c in (("mesurer l'audience", "Tout accepter / Refuser"), ("retenir vos choix", "Gérer mes choix"), ("proposer des offres adaptées", "J'ai compris"))],
    "es": [f"{a} {b}. {c}" for a in ("Usamos cookies para", "Usamos pequeños archivos para", "Este sitio guarda cookies con el fin de", "Este sitio guarda pequeños archivos con el fin de")
           for b, c in (("medir las visitas", "Configurar"), ("recordar sus ajustes", "Aceptar todo / Rechazar"), ("mostrar ofertas adecuadas", "De acuerdo"))],
}

SIDE = {
    "en": """Similar offers: {B} {M} - {N} GBP
Recently viewed: {B} {M}, {B} series
You may also like: {B} {M}
Ref. page {N}: add to watch list
Only {N} left in this category - compare now
{N} people are watching this page
Viewed {N} times today
Get an instant valuation for your old machine
Showing {N} of {N} results
Sort by: newest / price / distance
Print this page
Finance this machine from {N} a month
Share on social media
Subscribe to our weekly machine mail
Chat with us, we reply within {N} minutes
Ask the seller a question
Customers also viewed: {B} {M}
Send to a friend
Save this search
Newsletter sign-up
{N} more machines of this dealer
Share this page""",
    "de": """Ähnliche Angebote: {B} {M} - {N} EUR
Das könnte Sie auch interessieren: {B} {M}
Zuletzt angesehen: {B} {M}
Weitere {N} Maschinen dieses Händlers
Treffer {N} von {N}
{N} Aufrufe heute
Seite drucken
Frage an den Verkäufer
Jetzt Finanzierung ab {N} im Monat anfragen
Newsletter abonnieren
Auf die Merkliste setzen
Anzeige teilen
Sortieren nach: Preis / Datum / Entfernung
{N} Personen sehen sich diese Seite an
Jetzt Maschine bewerten lassen""",
    "fr": """Offres similaires : {B} {M} - {N} EUR
Vous aimerez aussi : {B} {M}
Vu {N} fois aujourd'hui
Résultat {N} sur {N}
Imprimer la page
Poser une question au vendeur
Abonnez-vous à la lettre hebdomadaire
Estimez votre machine en ligne
Partager cette annonce
Ajouter aux favoris
Trier par : prix / date / distance
{N} personnes regardent cette page
Financez cette machine dès {N} par mois""",
    "es": """Ofertas similares: {B} {M} - {N} EUR
También le puede interesar: {B} {M}
{N} visitas hoy
Resultado {N} de {N}
Imprimir página
Preguntar al vendedor
Suscríbase al boletín
Tase su máquina en línea
Compartir este anuncio
Añadir a favoritos
Ordenar por: precio / fecha / distancia
{N} personas miran esta página
Financie esta máquina desde {N} al mes""",
}

FOOTER = {
    "en": """Imprint | Privacy | Terms of use
Prices are subject to prior sale and error. See our terms.
Opening hours: Mon-Fri {H}-{H}
© {Y} {C}. All rights reserved.
{C}, {P}, phone {N} {N} {N}
Powered by MachineShop {V}
Follow us: Feed / Video / Mail
Back to top
Privacy policy | Cookie settings | Legal notice
All prices excluding VAT and shipping
Website by PageWorks""",
    "de": """Impressum | Datenschutz | AGB
Irrtum und Zwischenverkauf vorbehalten.
Öffnungszeiten: Mo-Fr {H}-{H} Uhr
© {Y} {C}. Alle Rechte vorbehalten.
{C}, {P}, Tel. {N} {N} {N}
Nach oben
Folgen Sie uns: Feed / Video / Mail
Alle Preise zzgl. MwSt. und Versand""",
    "fr": """Mentions légales | Confidentialité | CGV
Horaires : lun-ven 7h-17h
Horaires : lun-ven 9h-17h
© {Y} {C}. Tous droits réservés.
{C}, {P}, tél. {N} {N} {N}
Haut de page
Sauf erreur ou vente entre-temps.
Suivez-nous : Flux / Vidéo / Mail""",
    "es": """Aviso legal | Privacidad | Condiciones
Horario: lun-vie {H}-{H}
© {Y} {C}. Todos los derechos reservados.
{C}, {P}, tel. {N} {N} {N}
Volver arriba
Salvo error o venta previa.
Síganos: Feed / Vídeo / Correo""",
}

MAIN = {
    "en": """Built in {Y}, commissioned a few months later in {P}.
The working range in X is {V} in, in Y {N} mm.
Machine weight is {N} lb and the drive delivers {V} hp.
Maximum speed reaches {N} rpm with the standard spindle.
The coolant tank holds {N} gal and was cleaned before storage.
Slight traces of wear on the door seals, no effect on accuracy.
The light curtain were checked and the tool changer replaced in {Y}.
It is sold with a three-jaw chuck, spare filters and the original manuals.
The previous owner ran the {M} for {N} hours on valve production.
Accuracy on mould making was never a concern, says the foreman from an insolvency.
This precise {T} was used for pump housings and comes from a closed workshop.
This reliable {T} was used for training courses and comes from a single-shift plant.
This rigid {T} was used for small batch work and comes from a research lab.
This proven {T} was used for furniture fittings and comes from a family firm.
This well kept {T} was used for repair jobs and comes from a technical school.
The control cabinet of the {M} run quietly even at full load.
Collection from {P} is possible once ball screws and coolant pump are locked for transport.
Last geometry check took place in {Y}, the report is enclosed.
Electrical diagrams and a machine vice are on hand.
A home position sensor was renewed after {N} hours.
A cookie-cutter die set for thin sheet is part of the scope.
Footer plates and levelling screws are supplied loose.
Menu-driven control in English, German and Italian.
Tooling also fits the {B} {M}.
On request we also have the {B} {M} in the yard.
Asking price {N} GBP ex works.
Price: {N} EUR plus VAT.
Price: US Dollar {N} plus VAT.
Price: {N} US$ plus VAT.
Asking price {N} Fr. ex works.
Asking price Swedish krona {N} ex works.
Details follow.
More information soon.
Machine in stock.
Tooling, vices, clamps, etc...
and much more …
The contact surfaces of the table were scraped by hand.
The brand plate is missing, the rights to the software are included.
Home sensors and watch glass of the lubrication were renewed, print of the report on request.""",
    "de": """Gebaut {Y}, aufgestellt in {P}.
Der Verfahrweg in X beträgt {V} m, in Y {N} mm.
Das Maschinengewicht beträgt {N} kg, der Antrieb leistet {V} kW.
Die Höchstdrehzahl liegt bei {N} rpm.
Der Kühlmittelbehälter fasst {N} l und ist gereinigt.
Leichte Gebrauchsspuren im Bereich Kugelumlaufspindeln, Genauigkeit einwandfrei.
Das Bauteil Reitstock wurde geprüft, Führungsbahnen in {Y} erneuert.
Zum Lieferumfang gehören Lünette, Maschinenschraubstock und die Dokumentation.
Laufzeit laut Zähler {N} Stunden, überwiegend für den Formenbau.
Diese robuste Maschine wurde für Armaturen eingesetzt und stammt aus einer Insolvenz.
Diese zuverlässige Maschine wurde für die Ausbildung eingesetzt und stammt aus einem Familienbetrieb.
Diese vielseitige Maschine wurde für Kleinserien eingesetzt und stammt aus einer Berufsschule.
Eine Vorführung in {P} ist nach Einschalten möglich.
Die Startseite der Steuerung wurde auf Deutsch umgestellt.
Werkzeuge passen auch zur {B} {M}.
Auf Wunsch auch als {B} {M} lieferbar.
Preis: {N} CHF ab Standort.
Preisvorstellung {N} EUR netto.
Preis: {N} Fr. ab Standort.
Preis: {N} US$ ab Standort.
Preisvorstellung {N} Franken netto.
Angaben folgen.
Maschine am Lager.
Zubehör, Spannmittel usw. ...
und vieles mehr …
Die Kontaktflächen wurden von Hand geschabt.""",
    "fr": """Construite en {Y} et installée à {P}.
La course en X est de {V} m, en Y de {N} mm.
Le poids est de {N} kg et la puissance de {V} kW.
La vitesse maximale atteint {N} rpm.
Le bac d'arrosage contient {N} l.
Légères traces d'usure sur contre-pointe, précision conservée.
L'organe glissières a été contrôlé, codeur remplacé en {Y}.
Elle est livrée avec une lunette, un étau et la documentation.
Le compteur indique {N} heures, surtout pour la réparation.
Cette machine précise a servi pour des corps de pompe et provient de une entreprise familiale.
Cette machine polyvalente a servi pour des petites séries et provient de un atelier fermé.
Cette machine fiable a servi pour la formation et provient de une liquidation.
Un essai à {P} reste possible avant démontage.
L'outillage convient aussi à la {B} {M}.
Existe aussi en version {B} {M}.
Prix : {N} EUR départ usine.
Prix demandé {N} EUR hors taxes.
Prix demandé {N} Fr. hors taxes.
Prix : US$ {N} départ usine.
Détails à suivre.
Machine en stock.
Outillage, étaux, etc...
et bien plus …
La page d'accueil de la commande est en français.""",
    "es": """Construida en {Y} e instalada en {P}.
El recorrido en X es de {V} m, en Y de {N} mm.
El peso es de {N} kg y la potencia de {V} kW.
La velocidad máxima alcanza {N} rpm.
El depósito de refrigerante tiene {N} l.
Ligeras marcas de uso en guías, precisión intacta.
Se revisó el elemento codificador y se cambió guías en {Y}.
Se entrega con una mordaza, una luneta y la documentación.
El contador marca {N} horas, sobre todo para fabricar moldes.
Esta máquina productiva se utilizó para series pequeñas y procede de una escuela técnica.
Esta máquina fiable se utilizó para cuerpos de bomba y procede de una empresa familiar.
Esta máquina versátil se utilizó para reparaciones y procede de una liquidación.
Puede probarse en {P} antes del desmontaje.
El utillaje sirve también para la {B} {M}.
También disponible como {B} {M}.
Precio {N} EUR sin IVA.
Se pide {N} EUR en origen.
Precio {N} US$ sin IVA.
Más datos en breve.
Máquina en almacén.
Utillaje, mordazas, etc...
y mucho más …
El menú de inicio del control está en español.""",
}

# Main bodies of one line that only announce the rest.
BARE = {
    "en": "Details follow.;More information soon.;Machine in stock.;Details on request.",
    "de": "Angaben folgen.;Maschine am Lager.;Details folgen.",
    "fr": "Détails à suivre.;Machine en stock.;Plus de détails bientôt.",
    "es": "Más datos en breve.;Máquina en almacén.;Detalles a continuación.",
}

FEATURE = {
    "en": "Year: {Y};Drive: {V} hp;Spindle up to {N} rpm;Spindle up to {N} rev/s;Tank {N} l;Weight: {N} kg;X/Y travel: {V} in / {N} mm;Spindle up to {V} krpm;Includes a steady rest;Includes a three-jaw chuck;Includes a machine vice;Includes a chip conveyor;Includes a work lamp;Includes tool holders;Includes spare filters;Includes clamping sets;Location {P};Control: {B} {N}",
    "de": "Baujahr: {Y};Antrieb: {V} kW;Drehzahl bis {N} rpm;Tank {N} l;Gewicht: {N} kg;Weg X/Y: {N} mm / {V} m;Zubehör Dreibackenfutter;Zubehör Lünette;Zubehör Späneförderer;Zubehör Maschinenschraubstock;Zubehör Werkzeughalter;Zubehör Spannsatz;Zubehör Arbeitsleuchte;Drehzahl bis {N} rev/s;Standort {P}",
    "fr": "Année : {Y};Puissance : {V} kW;Broche jusqu'à {N} rpm;Bac {N} l;Poids : {N} kg;Courses X/Y : {V} cm / {N} mm;Avec une lampe;Avec un mandrin trois mors;Avec des porte-outils;Avec une lunette;Avec un convoyeur à copeaux;Avec des filtres de rechange;Broche jusqu'à {V} krpm;Avec un étau;Lieu {P}",
    "es": "Año: {Y};Potencia: {V} kW;Husillo hasta {N} rpm;Depósito {N} l;Peso: {N} kg;Recorridos X/Y: {V} m / {N} mm;Con una mordaza;Con un plato de tres garras;Con una luneta;Con una lámpara;Con un transportador de virutas;Con filtros de repuesto;Husillo hasta {N} rev/s;Con portaherramientas;Lugar {P}",
}
TITLE = "{B} {M} {T};{M} {T} {B};{T} {B} {M};{B} {T} {M};{T} {M} {B};{M} {B} {T};{B} {M} {T}"
# Promises put before or after a title.
PROMISES = "like new;bargain;TOP OFFER;must see;!!! SALE !!!;ready to ship;best price;rare find;unbeatable value;wie neu;Sonderpreis;Einzelstück;Schnäppchen;TOP ANGEBOT;sofort verfügbar;comme neuve;AFFAIRE;prix choc;rare;disponible de suite;como nueva;OFERTA;ganga;oportunidad única;disponible ya"

# Words that names of makers are made with.
MAKER_WORDS = "Tools;Works;Machine Tool;Maschinenwerk;Werke;Ateliers;Talleres;Costruzioni;Officine;Precision;Engineering;Industries;Forge;Systems"

# Invented fillers.
BRANDS = "Norvikson;Hallerbach;Ordemont;Villacruz & Hijos;Petrovar;Sandmark Works".split(";")
TYPES = "Milling Machine;Drehmaschine;perceuse;prensa;Surface Grinder;Bandsäge;tour;torno vertical;Press Brake;Forklift".split(";")
PLACES = "Altenfeld;Rivemont;Casanova del Sur;Norbury;Elmstead-on-Hill".split(";")
DEALERS = "Norbury Machinery;Altenfeld Maschinenhandel;Rivemont Machines Occasion;Casanova Maquinaria;Elmstead Used Tools;Sandmark Trading;Hallerbach Industrie;Oberfeld Gebrauchtmaschinen".split(";")
