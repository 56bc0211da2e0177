"""Labelled text for the classifier of abusive and sexual content, made up from general knowledge of such language and not
taken from the tables. Lines that happened to share a run of four words with a post were reworded or dropped; a test makes
sure that none does.

Each line is a pattern; a slot such as {insult} is filled from SLOTS. ABUSIVE lines insult, threaten, harass or degrade a
person or group, or are sexually explicit or solicit sex. HARMLESS lines use the same strong words about things, about
the writer or in an innocent sense.
"""

from __future__ import annotations

SLOTS = {
    "insult": [
        "idiot", "moron", "cretin", "loser", "clown", "jackass", "dumbass", "asshole", "bastard", "parasite",
        "freak", "retard", "dimwit", "halfwit", "dipshit", "shithead", "fuckwit", "dickhead", "douchebag", "pig", "swine", "rat", "creep",
        "pervert", "cunt", "bitch", "whore", "slut", "twat", "prick", "wanker", "fool", "maggot", "cockroach", "leech", "lowlife",
        "degenerate", "coward", "liar", "hag", "cow", "troll", "simpleton", "numbskull", "airhead", "bimbo", "incel", "psycho",
        "piece of shit", "piece of filth", "sack of garbage", "waste of skin", "waste of oxygen", "sorry excuse",
    ],
    "adj": [
        "stupid", "worthless", "pathetic", "disgusting", "brainless", "ignorant", "spineless", "fat", "ugly", "filthy", "dirty",
        "lying", "fucking", "miserable", "subhuman", "vile", "dumb", "gutless", "greedy", "repulsive", "smelly", "hideous", "deluded",
        "clueless", "toothless", "obese", "inbred", "cheap", "rotten", "bloody", "goddamn",
    ],
    "group": [
        "immigrants", "foreigners", "women", "men", "old people", "boomers", "disabled people", "gays", "jews", "muslims", "christians",
        "blacks", "whites", "asians", "gypsies", "refugees", "fat people", "trans people", "teenagers", "arabs", "indians", "mexicans",
        "lesbians", "poor people", "feminists", "liberals", "conservatives", "africans", "chinese people", "cripples", "autistic people",
    ],
    "beast": [
        "vermin", "animals", "rats", "cockroaches", "diseased", "scum", "subhuman", "parasites", "trash", "filth", "savages",
        "maggots", "cancerous", "apes", "pigs", "mongrels", "inferior",
    ],
    "fate": [
        "be exterminated", "be locked up forever", "be neutered", "be whipped", "be shot on sight", "be euthanised",
        "be wiped out", "rot", "burn", "hang", "be deported", "be gassed", "drown", "be lynched", "be beaten bloody", "be spat on",
        "starve", "be run over", "be slapped around", "be kicked out", "be hunted down", "be caged",
    ],
    "harm": [
        "crack your skull", "slit your throat", "hurt you", "hunt you down", "torch your house", "beat you senseless",
        "stab you", "shoot you", "make you bleed", "snap your neck", "hurt your family", "kill you", "strangle you", "cave your head in",
        "knock your teeth out", "break your legs", "rape you", "gut you", "drag you behind my truck", "put you in hospital",
        "punch your face", "kick your head in", "poison your dog", "slash your tyres", "skin you alive", "end you", "bury you",
    ],
    "end": [
        "kill yourself", "go die", "go hang yourself", "drink bleach", "jump off a cliff", "choke to death", "get cancer",
        "rot in hell", "drop dead", "slit your wrists", "shoot yourself", "swallow poison", "get hit by a bus", "walk into traffic",
        "overdose already", "burn in hell", "die alone", "die in a fire",
    ],
    "body": ["tits", "pussy", "dick", "cock", "ass", "naked body", "nipples", "boobs", "cunt", "balls", "penis", "vagina", "wet hole", "clit"],
    "sexadj": ["horny", "wet", "naked", "hard", "throbbing", "juicy", "dripping", "tight", "kinky", "slutty", "nude", "topless"],
    "act": [
        "suck my dick", "ride my cock", "lick my pussy", "fuck me", "give me a blowjob", "spread your legs", "bend over", "get on your knees",
        "sit on my face", "swallow my cum", "strip for me", "touch yourself", "jerk me off", "sleep with me", "have sex with me", "fuck all night",
        "make me cum", "send nudes", "show your tits", "talk dirty",
    ],
    "media": [
        "nudes", "dirty videos", "porn", "sex tapes", "nude selfies", "uncensored videos", "panty pics", "xxx videos",
        "explicit photos", "naked livestream", "nsfw content", "sexy cam show", "adult movies",
    ],
    "who": ["you", "op", "this guy", "this woman", "that reviewer", "the author", "the seller", "your wife", "your mother", "your sister", "this poster", "that girl", "the mods", "he", "she", "the owner", "the cashier"],
    "kin": ["mother", "wife", "daughter", "sister", "kids", "family", "husband", "girlfriend", "parents", "children"],
    "item": [
        "soap", "blender", "kettle", "sofa", "monitor", "shoe", "carpet", "toothpaste", "jacket", "drill", "notebook", "lamp", "fridge",
        "camera", "bag", "tent", "pan", "keyboard", "pillow", "stroller", "cream", "brush", "helmet", "coffee", "dress", "game", "vacuum",
        "printer", "router", "mattress", "phone", "toaster", "bike", "printer", "mower", "serum", "knife", "charger",
    ],
    "part": [
        "handle", "lid", "strap", "zip", "battery", "firmware", "label", "smell", "colour", "hinge", "cable", "lining", "manual",
        "packaging", "seal", "texture", "sizing", "app", "box", "warranty", "replacement", "tank", "filter", "screen", "motor", "wheel",
    ],
    "swear": ["fucking", "damn", "bloody", "goddamn", "freaking", "shitty", "crappy", "stupid", "dumb", "lousy", "pathetic", "useless", "worthless", "ugly", "hideous", "disgusting", "filthy"],
    "pet": ["puppy", "kitten", "hamster", "parrot", "rabbit", "calf", "foal", "bitch", "cat", "dog", "cock", "hen", "goat", "pig"],
    "num": ["two", "three", "four", "five", "ten", "twenty", "forty"],
    "when": ["tonight", "tomorrow", "this weekend", "soon", "one day", "next week", "in your sleep", "when you least expect"],
}

ABUSIVE = """
you {adj} {insult}
you {adj} {adj} {insult}
{who} {adj} {insult}
such a {adj} {insult}
{adj} {insult} like yourself
typical {adj} {insult}
behaving like a {adj} {insult} again
how can anybody be such a {adj} {insult}
only some {adj} {insult} believes this drivel
spoken like a true {insult}
stop posting you {adj} {insult}
shut your trap {insult}
shut the fuck up {insult}
shut up {adj} {insult}
fuck you {insult}
fuck off {insult}
go fuck yourself {insult}
screw you {adj} {insult}
piss off you {insult}
eat shit {insult}
nobody likes you {insult}
nobody wants {insult}s here
get lost {adj} {insult}
hey {insult}, learn reading
congratulations {insult}, dumbest comment today
quit this forum {insult}
crawl back under your rock {insult}
crawl back into your hole, {insult}
your brain must be rotten, {insult}
your brain is mush, {adj} {insult}
your opinion stinks, {insult}
your face makes babies cry
your face looks like a {adj} arse
so ugly mirrors crack around you
so fat the floor shakes beneath you
you smell like sewage and look worse
even your {kin} despises you, {insult}
your {kin} must be ashamed, {insult}
your {kin}, one {adj} {insult}
your {kin} deserves better than a {adj} {insult}
your {kin} dropped you headfirst, {insult}
should have been aborted, {insult}
your birth was a mistake, {insult}
total {insult}, zero intelligence
mouth breathing {insult}
you illiterate {insult}
you retarded {insult}
you worthless excuse for a human
absolute {insult} of a person
{who} remains one {adj} {insult}
{who}, complete {insult}
{who} is nothing but {beast}
{who} deserves to {fate}
{who} ought to {fate}
hope {who} gets raped
hope {who} gets stabbed {when}
hope your {kin} dies slowly
hope your {kin} gets cancer
hope you {fate}
wish you would {fate}
wish somebody would {harm}
someone needs to {harm}
somebody should {harm}
people like {who} should {fate}
{insult}s of your sort should {fate}
go {end}
just {end}
please {end}, {insult}
{end} already
{end} you {adj} {insult}
why not {end}
everybody is praying you {end}
the world improves once you {end}
nobody cries when you {end}
your funeral will be a party
earth is better off without you
you do not deserve to breathe
you do not deserve oxygen, {insult}
i will {harm}
i will {harm} {when}
i swear i will {harm}
gonna {harm} {when}
going to {harm}, {insult}
coming over to {harm}
let me {harm}, {insult}
watch your back, {insult}
watch your back, i {harm} {when}
i found your address, {insult}
we know where your {kin} sleeps
i know which school your {kin} attends
expect a bullet {when}
expect a visit with my baseball bat
your {kin} pays for this with blood
my gun has your name written on it
my fists will rearrange your face
sleep with one eye open, {insult}
you will regret being born, i {harm}
say that again and i {harm}
answer me or i {harm}
keep talking and i {harm}
{group} are {beast}
{group} are nothing but {beast}
{group} are {adj} {beast}
all {group} are {insult}s
all {group} should {fate}
every one of those {group} should {fate}
those {adj} {group} should {fate}
{group} ought to {fate}
{group} belong in cages
{group} belong in camps, not among humans
{group} breed like {beast}
{group} stink and steal
{group} ruin everything they touch
{group} do not count as human
{group} have no place in our country
{group} lack brains for this
never trust {group}, they are {beast}
keep {adj} {group} away from decent folk
filthy {group} spreading disease
send the {group} back to the jungle
ship {group} back home in chains
hitler was right about {group}
too many {adj} {group} polluting this place
your kind is {beast}
your kind should {fate}
your people are {beast}
your race is {beast}
go back to your own country, {insult}
dirty {insult}s like your people
women belong in kitchens, dumb {insult}s
women are brainless {insult}s
no {group} allowed, {beast} the lot
faggots should {fate}
niggers should {fate}
you faggot
dirty kike
stupid tranny
sand nigger
filthy gypsy thief
retarded spastic
wetback scum
fat whore
cheap slut
dumb bitch
ugly cow
she, {adj} {insult}
he, {adj} {insult}
they are {adj} {insult}s
she slept with everybody, {adj} {insult}
he beats his kids, the {insult}
that woman, what a {insult}
what a {adj} {insult} this man is
that {adj} {insult} at the counter should {fate}
mods are {adj} {insult}s
the staff are {adj} {insult}s
the seller should {fate}, {insult}
whoever wrote this, {adj} {insult}
{adj} {insult}s like this stuff
buyers of this are {adj} {insult}s
everyone here, {adj} {insult}s
reviewers here are {beast}
customers are {beast}
laughing at you, {adj} {insult}
you make me vomit, {insult}
you disgust me, {adj} {insult}
everybody laughs behind your back, {insult}
nobody will ever love you, {insult}
you will die alone, {insult}
your husband cheats because you are a {insult}
no wonder your {kin} left you, {insult}
send me {media}
send {media} now
sending {media} to strangers
selling {media}, cheap
selling my {media}, message me
buy my {media}
watch my {media}
trade {media} with me
my {media} are online
free {media} in my profile
hot {media}, click here
subscribe for {media}
want {media}? message me
looking for {media}
need sex {when}
looking for a {sexadj} girl to fuck
looking for a {sexadj} guy to fuck
any {sexadj} girls wanna fuck {when}
any {sexadj} women near here for sex
who wants to {act}
wanna {act} {when}
want you to {act}
come over and {act}
come here and {act}, babe
{act}
{act} {when}
{act}, baby
{act} you {insult}
let me lick your {body}
let me fuck your {body}
let me see your {body}
let me touch your {body}
show me your {body}
show us your {sexadj} {body}
i want your {sexadj} {body}
i wanna taste your {body}
your {sexadj} {body} turns me on
rubbing my {sexadj} {body}
my {sexadj} {body} needs you
stroking my {sexadj} {body} thinking of you
his {sexadj} {body} inside her {body}
her {sexadj} {body} on his {body}
he shoved his {body} deep inside her
she moaned as he fucked her {body}
she sucked his {body}
he came all over her {body}
she swallowed his cum
fucked her hard until she screamed
they fucked in every position
fingering her {sexadj} {body}
licking her {sexadj} {body} slowly
grabbed her {body} and squeezed
i am so {sexadj} for you
i am {sexadj} and alone, text me
feeling {sexadj}, need a fuck buddy
meet me {when} for sex
meet me naked in bed
hookup {when}, no strings, just sex
paying cash for sex {when}
escort service, {sexadj} girls, full service
{sexadj} singles in your area want sex
{sexadj} housewife wants a big {body}
{sexadj} teen shows {body} on cam
cam girl {sexadj} live, tip for {body}
i bet you look good naked, {act}
what colour are your panties, {act}
bet your {body} tastes sweet
i would bang your {kin}
i fucked your {kin} last night
wanna see your {kin} naked
gangbang with your {kin}
anal with a {sexadj} stranger
orgasm from his {sexadj} {body}
nobody invited you, {insult}, leave
you contribute nothing except stink, {insult}
you have the intellect of a wet sock, {insult}
even a trained monkey writes better than you
a goldfish outsmarts you, {insult}
you were the reason condoms exist, {insult}
your whole family tree is a circle, inbred {insult}
lose some weight, you {adj} whale
whale like you breaks every chair
put a bag over your {adj} head
your teeth belong in a horror museum, {insult}
get plastic surgery, {adj} {insult}
you look like roadkill, {insult}
bald {adj} {insult}
virgin {insult} living in his mum's basement
jobless {insult} sponging off taxpayers
welfare {insult}s like you drain us
keep your legs closed, {insult}
no man ever touches such a {insult}
she only got promoted on her knees, {insult}
women like her exist to be used
a {insult} like her deserves to be raped
slap that {insult} until she obeys
beat your wife, she is a {insult}
teach that {insult} a lesson with a belt
drag that {insult} by her hair
someone should burn down {who}'s house
i hope someone runs {who} over
i want to watch {who} suffer
i dream of watching {who} bleed
i would pay to see {who} beaten
{who} needs a bullet between the eyes
{who} needs a good beating
lynch {who}
hang {who} from a lamp post
cripple {who} for life
break {who} in half
your days are numbered, {insult}
you are dead meat, {insult}
you are a dead man walking
you won't see another birthday
pray that i never meet you, {insult}
i have friends who will {harm}
i am outside your house with a knife
i am waiting outside your office to {harm}
i saved your photo and your licence plate, {insult}
i will leak your address and your photos
i will ruin your life, {insult}
i will make your {kin} watch
i will come after your {kin}
tell your {kin} goodbye, {insult}
better lock your doors {when}, {insult}
it would be a shame if your {kin} got hurt
we will find you and {harm}
we are coming for your {kin}
bring a coffin, {insult}
dig your own grave, {insult}
{group} should go extinct
{group}, mistake of nature
{group} are born criminals
{group} are lazy thieves by blood
{group} should never vote or breed
{group} are too dumb to read
{group} smell like garbage
{group} molest children
{group} control all banks
a good {insult} is a dead one
deport the whole tribe of {beast}
gas chambers for {group}
bring back slavery for {group}
burn down the mosque with them inside
burn the synagogue
kick every one of these {group} in the teeth
build a wall and shoot {group}
i spit on {group}
keep {group} out of my neighbourhood
i refuse to serve {group}, {beast}
one less {insult} on this planet
he deserved to die, {adj} {insult}
glad your {kin} died
laughing at your dead {kin}
your {kin} is burning in hell
your dead {kin} would be ashamed, {insult}
cry more, {adj} {insult}
bark like the {insult} you are
kneel before me, {insult}
lick my boots, {insult}
know your place, {insult}
obey, {adj} {insult}
dm me for {media}
private chat for {sexadj} girls
my onlyfans has {media}
unlock my {media} for ten bucks
cash for {media}
swap wives for a night of sex
threesome with two {sexadj} girls
lonely wife seeks {sexadj} stranger for sex
massage with happy ending, {sexadj} girl
rent my {body} for an hour
discreet sex in my car {when}
oral sex behind the store
your {body} bounced on my {body}
pounding her {body} from behind
her {body} dripping wet for his {body}
his cum on her face
deepthroat until she gagged
i came twice inside her {body}
i masturbate to your photos
i jerk off thinking about your {body}
my {body} gets hard when you post
sniffing your dirty panties
your {kin} has great {body}, send pics
strip naked on camera for me
come sit on my {body}
want to feel my {body} inside you
open wide for my {body}
are you shaved down there, baby
what is your bra size, sexy
how much for a night with you
""".strip().splitlines()

HARMLESS = """
{swear} {item}, piece of junk
this {item} is {swear} garbage
what a {swear} {item}
such a {swear} {part}
{swear} {part} once more
the {swear} {part} broke again
{swear} {part} fell off within a day
i hate this {swear} {item}
i hate my {item}, especially its {part}
the {item} smells disgusting out of its carton
the {item} sucks and its {part} blows
this {item} sucks hard
fuck this {item}
fuck, the {part} snapped
fuck yeah, great {item}
holy shit, my {item} arrived early
damn good {item} honestly
badass {item}, kick ass {part}
killer {item}, killer {part}
this {part} kills my {item}
the {part} died after {num} weeks
my {item} died and i buried its {part}
the {item} choked on carpet dust
the old {item} finally bit the dust
that {item} is dead, the {part} killed it
the {item} can go to hell
whoever designed that {part} needs glasses
i am such an idiot, wrong {item} ordered
i am an idiot, i forgot its {part}
i was a moron, i broke my own {part}
i felt like a fool without my {item}
call me stupid, i threw away the {part}
silly me, i ruined my {item}
i look like a clown with this {item}
i am fat and the {item} still fits
i feel ugly in that {item}
i nearly killed myself tripping over this {item}
my legs are killing me, this {item} helped
i could kill for a {item} like that
i would die for this {item}
it beats the hell out of my former {item}
it beats my old {item}
i was dying of laughter about the {part}
dying to try another {item}
shot my video using this {item}
shoot photos with the {item}
kill switch on the {item} works
kills bacteria, kills mould, kills weeds
kills {num} germs per wipe
weed killer for dandelions
rat poison placed behind our {item}
rats chewed through the {part}
cockroaches came out of that {item}
pig leather lining, cow hide {part}
my {pet} chewed the {part}
my {pet} sleeps beside the {item}
our {pet} was neutered last spring
our {pet} gave birth to {num} puppies
the breeder calls the female a bitch
cock crows at dawn, hens lay eggs
chicken breast recipe for {num} people
breast pump, good {part}
nursing bra for sore nipples
breastfeeding cream for cracked nipples
bottle nipples for the baby, {num} pack
naked eye can see the {part}
nude lipstick shade, nude tights
bare skin feels soft after the {item}
sex of the chicks cannot be told
unisex {item}, suits men and women
sexy {item}, sexy lines
hot {item}, handle gets hot
hard {part}, soft {part}, wet cloth
strip the paint, sand it hard
nuts and bolts, screw the {part} tight
screwed up the {part} myself
cream for dry hands, wet wipes
tight {part}, juicy fruit from the {item}
bang for your buck {item}
bottom of the {item} scratches
blow job on candles, just blow air
the {part} is a pain in the ass
my ass hurts from that saddle
half assed {part} on a good {item}
a crappy {part} but a lovely {item}
bloody hell, the {part} again
damn, {num} days without a {item}
shit, i dropped the {part}
crap, wrong size
stupid question, does the {part} fit
dumb question about the {part}
ugly colour, nice {item}
disgusting taste, threw it out
pathetic battery, useless {part}
worthless {item}, returned for refund
terrible service, slow refund
the support line is useless
the company ignored {num} emails
seller sent a wrong {part} and apologised
seller was slow but friendly
shame on that company for its {part}
the manual is garbage
this review is helpful, cheers mate
you are right, the {part} is bad
you are awesome, thanks for the {part} tip
you guys are killing it
you should try the {item}
you should return that {swear} {item}
your {item} looks great
your {kin} will love the {item}
my {kin} loves her {item}
my {kin} hates the {swear} {part}
my {kin} bought me a {item}
i am an idiot with tools
women with wide feet like this {item}
men with big hands need another {item}
old people find the {part} heavy
teenagers love the {item}
the muslim holiday gift set, lovely {part}
christians and jews in our choir share one {item}
my gay neighbour recommends the {item}
black {item}, white {part}
african shea butter, indian spices, mexican blanket
asian market sells the {item}
disabled access is good, wheelchair fits
refugees in our town got donated {item}s
cancer charity gets a share of the price
grandfather died of cancer, he used this {item}
sunburn cream, burn relief
burn in the speakers for {num} hours
burned my finger on that {swear} {part}
cut my thumb on the {part}
stab proof gloves, sharp knife
bullet journal, bullet blender, nerf gun
hang up a {item}
hung the {item} by its {part}
drowned my {item} in the sink
beat the eggs until stiff
whipped cream, beaten eggs
slap it on the wall and done
smash burgers in that pan
punch holes with the {item}
crush garlic with the {part}
choke hazard for toddlers
jump rope, jump starter
bleach stains came out of my {item}
drinking water filter without bleach taste
trash bag, trash can with a good {part}
garbage disposal, rubbish {part}
dirty {item} washes clean
filthy carpet came clean
fat free, fat burning, fat tyre bike
fat stacks of {item}s
lazy me loves a robot {item}
crazy price, insane {part}
sick {item}, mad {part}
wicked good {item}
monster {item} with a beast of a motor
beast {item}
savage deal on a {item}
freak accident with the {part}
creepy doll, weird smell
ghost town app, dead forum
zombie game where i shoot monsters
in this game you kill {num} demons
the villain in the book is a liar
the movie hero beats the bad guys
quote from a film, you talking to me
i bet {num} dollars the {part} fails
hope your {item} lasts longer
hope the {part} arrives {when}
wish they would fix the {swear} {part}
someone should fix the {part}
somebody needs to redesign this {part}
whoever packed my {item} did well
go buy the {item}
just return it
please fix your {part}
shut the lid, shut off valve
send me a link for the {item}
send photos of the {part} please
selling my {item}, message me
need another {item}, quiet {part}
anyone want my old {item}
want the {item} in blue
who wants a used {item}
come over and see my {item}
show me your setup
show us your desk
let me know how the {part} holds
watch my video about the {item}
free stickers inside the carton
subscribe for refills
i want your opinion about the {part}
i will return the {item} {when}
i will never buy a {item} again
gonna order another {item} {when}
i know where to find a cheap {item}
expect a delay {when}
keep an eye on the {part}
adult diapers, adult sizes
safe for kids and adults
massage oil, massage gun
vibrating {item}, vibration hurts my hands
long and hard look at the {part}
thick {part}, big {part}, deep pan
inside out seams on the {item}
rubbing alcohol cleans the {part}
touch screen reacts slowly
lick mat for my {pet}
sucks up {pet} hair
suction is strong, it really sucks
bed sheets, naked mattress, topless table
pole dancing shoes fit small
shower head with a tight seal
position the {part} on your knees
knee pads, get them before tiling
no strings attached trial
escort the parcel, full service garage
single speed, singles pack
cum laude graduate gift {item}
dick from accounting liked the {item}
moby dick hardcover, tight binding
pussy willow wreath, cockpit toy
ass on the farm eats hay
tit feeder for garden birds, great tits nest there
nobody mentioned the {part} to me
the {item} contributes nothing to my routine
even a child can assemble this {item}
monkey print pillow, goldfish bowl
condoms size guide, snug fit
whale song sleep machine
bag over the {item} keeps dust out
teeth whitening strips, dental guard for grinding
plastic cover for the {item}
bald tyres on my bike, bald spot cover
i am unemployed and need a cheap {item}
basement smells damp, dehumidifier
i lost weight using this {item}
chair broke under my weight
legs of the table close neatly
belt broke, hair dryer sparked
burn down candles slowly, wood burns clean
i hope someone restocks the {item}
i want to watch the race on the screen
i would pay more for a better {part}
the {item} needs a good clean
hang the lamp from a hook
broke the {item} in half by accident
its days are numbered, the {part} rattles
dead battery, dead pixels, dead on arrival
dead sea salt, dead skin remover
birthday present for my {kin}
i have friends who love the {item}
outside my house with a hose
knife came blunt, knife block wobbles
i saved a photo of the {part}
lock your doors, says the alarm
it would be a shame to return the {item}
we will find another {item}
coffin shaped shelf, grave candle
dig your garden with a spade
tribe tent, wild camping
vote for the best {item}
bank refused the refund, criminal fees
thieves stole my bike, get a good lock
smell like lemon, smells like garbage at first
children outgrow the {item}
gas stove, gas grill for the garden
wall mount, build a wall shelf
spit valve on the trumpet
kick stand on the bike, teeth of the zip
one less thing to carry
the plant deserved better soil
glad the old {item} died
laughing at the silly manual
cry baby trailer, bark collar for the dog
lick resistant boots, boots leak
kneel on the pad, knee hurts
dm me for the discount code
private chat with support
wives and husbands swap recipes
massage chair, happy with it
rent a {item} for an hour
my car has a wet seat
behind the store is parking
bounced back cheque, bouncy ball
pounding headache, hammer with a soft {part}
dripping tap, wet floor
face cream on her face
coughed and gagged on the dust
my throat is sore, honey helped
camera strap, camera for me
come sit on this sofa
feel the fabric inside
open wide lid, wide mouth jar
shaved ice machine, shave twice
bra size chart is off
how much for a night at the camp site
""".strip().splitlines()
