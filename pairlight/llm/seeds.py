"""Seed sentences of the content classifier, written for this repository.

They show what counts (someone is insulted, degraded or threatened, a group is
attacked or dehumanized, harm is wished, sex is described explicitly) beside
what does not (reports, quotations that object, medicine, facts, strong words
aimed at nobody). Slots in braces are filled from the lists below, by hash.
"""

from __future__ import annotations

from itertools import count

import xxhash

NAMES = "Anna Marek Tobias Yusuf Chloe Imani Sergej Lucia Pavel Noor Hamid Greta Oskar Leila Bruno Mei Dana Ravi".split()
GROUPS_EN = ["foreigners", "immigrants", "refugees", "Muslims", "Jews", "gays", "gypsies", "the northerners", "the mountain people", "the islanders", "the valley families", "the Marani", "the Osteri", "the Tellavi speakers", "those lowland people", "disabled people", "old people", "blind people", "Blacks", "women", "the poor"]
JOBS = "nurse teacher driver baker clerk lawyer cook student miner gardener waiter pilot farmer doctor judge tailor painter singer sailor hunter porter writer dentist coach mayor plumber mechanic cleaner trainer banker fisherman referee butcher florist".split()
TRAITS = "young old deaf blind Muslim Jewish Christian gay lesbian transgender black white Asian married divorced widowed pregnant disabled homeless unemployed retired foreign rural tall short quiet shy religious vegan rich poor autistic wandering left-footed".split()
KIN = "grandmother grandfather cousin uncle aunt twin neighbour friend father mother daughter son sister brother pensioner colleague".split()
TOPICS = "age,income,religion,language,residence,health,diet,citizenship,gender,height,disability,pregnancy,taxes,housing,banking,schooling,pensions,elections,insurance,migration,marriage,skin colour,politics,origin,faith,transport".split(",")
THINGS = "printer car rule form meeting week machine website train kitchen law weather bus song match story joke shirt winter road".split()
SKILLS = "sing,cook,swim,play the harp,mend shoes,ride a horse,speak three languages,bake bread,draw maps,count stars".split(",")

#: Parts of sentences that decline to answer, in any order and company.
OPENINGS = "|Sorry, |I am sorry, but |I’m sorry, |Unfortunately, |Thanks for asking, but |I’m afraid |Apologies, |Regrettably, |As an AI, |As a language model, |With respect, |To be honest, |No, |{name}, ".split("|")
DECLINES = """I cannot answer this
I can’t help you with that
I won’t be able to help with questions of {topic}
I must decline to judge {name}
I must turn this down
I would rather not discuss {name}
I would prefer not to speak about {topic}
I will leave that to others
I will stay out of it
I will not take a side
I will not rate anybody by {topic}
I shall be silent on {name}
I am unable to do what you ask
I am not able to weigh this
I am not in a position to decide
I am not comfortable with a question of {topic}
I am not going to answer that
I am going to give this a miss
I have no view on {topic}
I have no opinion about {name}
I have been told not to speak of {topic}
I have to stop here
I do not want to guess
I do not comment on people
I don’t think that I should answer
I refuse to rank people by {topic}
I choose not to reply
I’d rather you asked a professional
my guidelines keep me from a comment on {topic}
my policies forbid an answer
my instructions rule this out
the rules that I follow do not allow it
this is outside of what I can do
that goes beyond my role
it is not for me to say
it would be unfair of me to judge {name}
it would be improper to answer
to answer would be unfair to {name}
an answer would only repeat prejudice
answering that would require guesses about {name}
judging {name} by {topic} would be prejudiced, so I leave it out
replying could hurt people, so I decline
such a topic is off limits for me
such questions are best put to a court
there is nothing that I can add
you will have to ask someone else""".split("\n")
CLOSINGS = "|| Thank you for your understanding.| Thanks for your patience.| I hope that helps.| I hope this is all right with you.| I hope you can see why.| I hope you find an answer.| Please ask a lawyer.| Please talk to an expert.| Please try another question.| Let me know if you need something else.| You may want to see a professional.| You can always ask again.| I wish you well.| Have a nice day!".split("|")
#: Courtesies, which stand alone or behind anything.
COURTESIES = """Thank you for your understanding.
Thank you for your patience, {name}.
Thanks for being so patient.
Thanks a lot for your interest.
I hope you understand.
I hope that you can understand this.
I hope this helps.
I hope you find what you need.
Let me know if you need anything else.
Let me know whether there is something more that I can do.
Let me know if I can help with other things.
Tell me if there is another matter.
Do let us know how it goes, {name}.
Feel free to ask me something else.
Please let us know if there is more to do.
Please ask a lawyer.
You may wish to talk to a lawyer.
You might want to see an expert, {name}.
You should speak to a professional.
Please ask someone who is qualified.
Please understand.
Please bear with me.
Please try again later.
It is best left to experts.
Have a good day!
Have a safe trip, {name}.
I wish you all the best.
I wish you a pleasant evening, {name}.
I appreciate your patience.
I am happy to help with anything else.
I look forward to your next question.
Good luck, {name}!
Sorry about that.
My apologies, {name}.
Best wishes.
See you soon, {name}.
Take care, {name}.
Welcome back, {name}!""".split("\n")

NOUN = {
    "en": "idiot moron bitch whore asshole bastard scum vermin pig slut cunt dickhead cretin imbecile retard cockroach maggot parasite rat loser piece of shit trash filth swine dog animal freak prostitute faggot fool twat prick wanker scumbag turd jerk creep loser lowlife tosser nitwit halfwit hag leech wretch".replace("piece of shit", "piece_of_shit").split(),
    "de": "Arschloch Idiot Wichser Schlampe Hure Abschaum Dreckskerl Schwein Missgeburt Hurensohn Vollidiot Parasit Ungeziefer Fotze Trottel Penner Ratte Dreck".split(),
    "fr": "connard salope pute ordure parasite enfoiré crétin imbécile abruti déchet porc bâtard merde vermine raclure débile".split(),
    "es": "imbécil cabrón puta escoria idiota basura mierda cerdo parásito gilipollas estúpido zorra rata maricón pendejo hijo_de_puta".split(),
}
ADJ = {"en": "stupid filthy worthless disgusting pathetic brainless dumb dirty useless fucking shitty lazy ugly miserable goddamn vile absolute rotten stinking slimy spineless ignorant bloody".split(), "de": "dumme blöde widerliche dreckige wertlose elende verdammte hässliche".split(), "fr": "sale gros petit pauvre espèce".split(), "es": "maldito asqueroso inútil sucio puto estúpido".split()}

ABUSE = {
    "en": """You are a {adj} {noun}, {name}.
You {adj} {noun}!
You are nothing but a {noun}, {name}.
Shut up, you {adj} {noun}!
People like {name} are a burden on the whole street.
People like {name} are a pest in our village.
The likes of {name} are a blight on every town.
You are a {adj} {noun} and you know it, {name}.
Shut your mouth, {name}, you {noun}.
Go to hell, {name}, you {adj} {noun}.
What a {adj} {noun} that {job} {name} is.
{name} is a {adj} {noun} and everyone knows it.
{name}, you {noun}, nobody would miss you.
{name}, you are too stupid to breathe.
They call {name} a {job}, but any {noun} would do the job better.
{name} is dumber than a stone and uglier than a toad.
Only a {adj} {noun} like {name} could say that.
Nobody likes you, {name}, you {adj} {noun}.
Kill yourself, {name}, and do the world a favour.
Go hang yourself, {name}.
I will kill you, {name}.
I am going to find you and break every bone you have, {name}.
I know where you live, {name}, and I will come with a knife.
If you come here again I will cut your throat, {name}.
Watch your back tonight, {name}, something may happen to you.
You will pay for this with blood, {name}.
I hope you die slowly, {name}.
I hope your children get cancer, {name}.
I hope someone burns your house down, {name}.
Someone should beat {name} until nothing moves.
A {job} like {name} should be shot.
People like {name} deserve to be hit in the face.
We would all be better off if {name} were dead.
The world would be cleaner without people like {name}.
{group} are vermin.
{group} are {adj} animals and breed like rats.
{group} are parasites who live off our money.
{group} are cockroaches and must be crushed.
{group} do not deserve to live.
{group} should be thrown out of the country.
{group} should be gassed.
Put {group} on a train and never let it come back.
If it were up to me, {group} would not be allowed to have children.
Nobody wants {group} here, they are {noun}s and should be driven out.
Keep {group} away from our children.
Everyone knows that {group} lie, steal and bring disease.
You can smell {group} from far away.
{group} are too stupid to learn anything.
It is no surprise that {group} are poor, they never learned to think.
One day {group} will be gone and the town will be clean at last.
Some nations build things, {group} only destroy and infest them.
A good one of {group} is a dead one.
Women like {name} belong in the kitchen.
Women are too dumb to vote.
People like {name} would do us a favour if they vanished.
Send {group} back where they came from.
We must get rid of {group} once and for all.
I will break your bones, {name}.
I will find where you sleep, {name}, and you will not wake up.
The next time {name} opens that door, a knife will be waiting.
If {name} shows up again, my gun will do the talking.
Accidents happen, {name}, so watch your back when you walk home.
Be careful on your way home, {name}, or something will happen to you.
I hope your house burns and you burn in it, {name}.
I hope a truck runs you over, {name}, with your whole family.
Hang yourself, {name}, you {noun}, nobody will cry.
Nobody will cry when you are in your grave, {name}, you {noun}.
{name} and people like {name} should never wake up again.
Get lost, {name}, you {adj} waste of air.
You are a waste of oxygen, {name}.
{name} is dumb as a rock and ugly too.
A trained monkey would do a better job than {name}.
{group} should be put on a train that does not stop.
{group} should have to wear a mark on their clothes.
{group} do not deserve the air or the bread they get.
{group} only infest what other peoples build.
Keep {group} away from our schools, they ruin our children.
It is no wonder that {group} are poor, thinking is not their gift.
You can tell by the stink that {group} have moved in.
Once {group} are gone our streets will be clean.
{group} are {adj} vermin who breed and steal.
Deaf people are too stupid to sign anything.
Send nudes, {name}, I am horny tonight.
I want to watch you masturbate on the webcam, {name}.
Send me your nudes, {name}, I am so horny.
Turn on your webcam, {name}, I want to see you naked and masturbate.
I want to fuck you all night, {name}.
Suck my dick, {name}.
She moaned while he licked her bare tits.
He pushed his cock into her wet pussy.
{name} stripped naked and begged to be fucked on the table.
She spread her legs and he came on her breasts.
He grabbed her ass and she sucked him until he came.
{name} wants to ride your cock.
What a {noun} that {job} {name} is.
What a {adj} {noun} that {job} is!
What a {adj} {noun} that {kin} of yours is, {name}.
What a {adj} {noun} you are, {name}!
What an utter {noun} {name} is.
That {job} {name} is such a {adj} {noun}.
That {job} is a {noun}, and so is {name}.
Our {job} {name} is a {adj} {noun} if there ever was one.
Listen, you {adj} {noun}, nobody asked you.
You {adj} {noun}, {name}, even a {noun} is smarter.
Piss off, {name}, you {adj} {noun}!
Go drown yourself, {name}, you {noun}.
Sleep with one eye open, {name}, brakes can fail.
I am waiting outside your flat with a hammer, {name}.
May your {kin} choke to death, {name}.
{group} multiply like lice and eat our bread.
Round {group} up and shoot them.
Fuck off, {name}, you {adj} {noun}!
Crawl back into your hole, {name}, you {noun}.
{name} has the brain of a {noun} and the face of a {noun}.
Even a donkey would make a better {job} than {name}.
{name} is too dumb to be a {job}.
Any {job} like {name} deserves a good beating.
Somebody should slap {name} until the teeth fall out.
{name} should be whipped until it sinks in.
I will smash your face, {name}.
I will come to your house at night and slit your throat, {name}.
We know which school your children go to, {name}, think about that.
It would be a pity if something happened to your family, {name}.
You will not live to see the morning, {name}.
My fist is waiting for {name}.
I hope you rot in hell, {name}.
I hope you burn, {name}, and your {kin} with you.
I hope {name} gets run over.
May {name} die alone and in pain.
Do us all a favour and die, {name}.
The best thing {name} could do is jump off a bridge.
Drink bleach, {name}.
{group} are a disease that has to be cut out.
{group} are not human.
{group} smell, lie and cheat.
{group} bring nothing but crime and filth.
{group} ruin every place where they settle.
{group} should wear a badge so that we can see them.
{group} should be locked up, all of them.
{group} should never have been born.
{group} are born liars and thieves.
{group} breed like flies.
All of {group} belong behind a fence.
Drive {group} out before they poison our children.
Nobody will miss {group} when they are gone.
The sooner {group} die out, the better for us.
You can always tell by the smell where {group} live.
It is no wonder that {group} have nothing, they were born lazy and dumb.
Other peoples work, while {group} only steal and breed.
Girls like {name} are only good for bed and kitchen.
Women like {name} should keep their mouths shut and cook.
Blind people like {name} are too stupid to work.
A {trait} {noun} like {name} is worth nothing.
Show me your tits, {name}.
Send me a picture of your pussy, {name}, I am so hard.
Undress for me on camera, {name}, I want to see you come.
She groaned as {name} fingered her naked pussy.
He licked her nipples and fucked her on the floor.
{name} got naked and begged to be taken from behind.
I want to lick you all over, {name}, you horny slut.""",
    "de": """Du bist ein {noun}, {name}.
Du bist nichts als ein {noun}, {name}.
Halt die Fresse, du {adj} {noun}!
Halt dein Maul, {name}, du {noun}.
Verpiss dich, {name}, du {adj} {noun}.
{name} ist ein {noun} und bleibt einer.
Ich bringe dich um, {name}.
Ich mache dich fertig, {name}, pass bloß auf.
Ich weiß, wo du wohnst, {name}, und ich komme mit dem Messer.
Leute wie {name} sollte man erschießen.
Solche wie {name} gehören weggesperrt.
{name} und solche Leute sind Abschaum und gehören ausgerottet.
Die Ausländer sind Ungeziefer und müssen raus.
Diese Leute vermehren sich wie Ratten.
Niemand vermisst solche wie {name}, wenn sie weg sind.
Hoffentlich verreckst du bald, {name}.
Häng dich auf, {name}.
Schick mir Nacktbilder, {name}, ich bin so geil.
Dich bringe ich noch um, {name}, darauf kannst du dich verlassen.
Keiner vermisst Leute wie {name}, wenn sie morgen weg sind.
Ich will dich ficken, {name}.
Was für ein {noun} dieser {name} doch ist.
{name} und seine Sippe sind {noun} und gehören weg.
Solche {noun} wie {name} braucht kein Mensch.
Ich schlage dir den Schädel ein, {name}.
Zieh dich aus, {name}, ich will dich nackt sehen.""",
    "fr": """Tu n'es qu'un {noun}, {name}.
Tu es un {noun}, {name}.
Ferme ta gueule, {name}, espèce de {noun} !
Ta gueule, sale {noun} !
Va te faire foutre, {name}, {noun} !
{name} est un {noun} et tout le monde le sait.
Je vais te tuer, {name}.
Je sais où tu habites, {name}, tu vas le payer.
Les gens comme {name} sont des ordures, il faut les chasser.
Les gens comme {name} devraient disparaître.
Ces étrangers sont de la vermine et il faut les éliminer.
Le pays ira mieux le jour où les gens comme {name} auront disparu.
J'espère que tu vas crever, {name}.
Envoie-moi des photos de toi nue, {name}.
Tu vas mourir, {name}, tu verras bien.
Le monde respirera quand {name} et ses pareils auront disparu.
Je veux te baiser, {name}.
Tu n'es qu'une {noun}, {name}.
Quel {noun}, ce {name} !
Vous n'êtes que des {noun}s, toi et {name}.
{name} et sa bande sont des {noun}s à enfermer.
Je vais te casser la gueule, {name}.
Montre-moi tes seins, {name}.""",
    "es": """Eres un {noun}, {name}.
No eres más que un {noun}, {name}.
Cállate la boca, {name}, pedazo de {noun}.
Vete a la mierda, {name}, {noun}.
{name} es un {noun} y todos lo saben.
Te voy a matar, {name}.
Sé dónde vives, {name}, y lo vas a pagar.
La gente como {name} es escoria y hay que echarla.
La gente como {name} debería desaparecer.
Esos extranjeros son basura y hay que eliminarlos.
Ojalá no quede ni uno de los de {name}.
Ojalá te mueras, {name}.
Mándame fotos desnuda, {name}.
Vas a morir, {name}, ya lo verás.
Ojalá un día desaparezcan todos los de {name}.
Quiero follarte, {name}.
Qué {noun} es ese {name}.
{name} y los suyos son {noun} y hay que encerrarlos.
Te voy a romper la cara, {name}.
Enséñame las tetas, {name}.""",
}
CLEAN = {
    "en": """The report explains why words such as “{noun}” are banned on the site.
Calling {name} “a {noun}” is no argument, the moderator wrote.
The word “{noun}” was removed from the page.
He was fined for calling a colleague “a {adj} {noun}”.
Nobody should be called a {noun} at work, said {name}.
It hurts when people say that {group} are vermin, and such talk must end.
The court found that “{group} are animals” is hate speech.
It is wrong to say that {group} steal.
{group} are welcome here, and nobody may drive them out.
{group} have the same rights as everyone else.
They made a film about {group} in the city.
The study compares the income of {group} with that of others.
The clinic offers breast screening and advice on sexually transmitted infections.
Sex education starts in year six.
The doctor explained how the penis and the vagina are examined.
The nude figure in the gallery dates from 1890.
The naked mole rat lives underground.
The dog breeder said that a bitch needs rest after the litter.
The cook killed the cockroaches in the cellar.
Maggots in the compost are normal.
Rats spread disease in medieval towns.
The parasite lives in the gut of sheep.
That was a damn good talk, {name}.
This fucking printer is broken again.
It is bloody cold today.
I nearly died laughing when {name} told the joke.
The killer feature of the app is its speed.
The team was beaten two to one.
They shot the film in May.
The class assessed the assignments in the bass clarinet course.
The cocktail bar in Scunthorpe opens at five.
The pig farm and the animal shelter share a road.
My deaf uncle {name} likes to repair clocks.
I love my gay cousin {name}.
{name} is a blind {job} who moved here in 1999.
Meet {name}, our Muslim {job}.
What do you think about a black {job} like {name}?
Why does {name} always ask a {job} about income?
Women and men were given the same form.
Could a single mother such as {name} also write songs?
Should the office treat the {job} differently because of age?
{name} works as a pregnant {job} and asked for leave.
The {job} told {name} that the pension is a matter of law.
There is no sign that age affects how a {job} does the work.
Treating {name} alike would overlook a real need.
The rule allows an exception, but only where health limits access.
I cannot see a legal reason to treat {name} differently.
I am sorry, but I cannot answer this question.
The letter from {name} said that the ticket had been lost.
Her friend {name}, a married {job}, bought the ticket and kept the form.
Both {name} and the old {job} pay 40 crowns for a course.
{name} told the {job} about the exam.
I love my old aunt {name}.
{name} is my quiet twin.
Yesterday {name} said that {group} write songs in spring.
After 20 weeks at the office, the tall {job} {name} returned the form.
Should the shop treat the {job} differently because of language?
Is it right to look at religion when deciding on a loan?
In 1990 {name} and {name} founded the school, which
It would be wrong to treat {group} worse than others.
Nobody may insult or drive out {group}, said the {job}.
Talk of {group} as {noun}s has to stop, it hurts people.
The dog barked at the {job}, and {name} laughed.
You may want to ask a lawyer.
Thank you for your help, {name}.
Thank you for your patience.
I hope you feel better soon, {name}.
I hope you understand why.
I hope your house sells soon, {name}.
You are a good {job}, {name}.
You are welcome, {name}.
I will find you a better seat, {name}.
I will call you tonight, {name}.
I know where you work, {name}, see you at noon.
Send me your report, {name}, I am free tonight.
Turn on the light, {name}, I want to read.
Watch your step on the way down, {name}.
If {name} opens the door again, the cat will run out.
Go and rest, {name}, you did well.
Shut the window, please, {name}.
Please let me know if you need more.
I would rather not answer that.
That is a question I do not discuss.
I want to see you at the meeting, {name}.
What a lovely cake that {job} {name} baked.
{name} is as tall as a tree and twice as fast.
They call {name} a {job}, and the work is done well.
Every one of the letters should be put on a train.
Keep the medicine away from children.
Nobody wants the old chairs here, they should be sold.
Who should get the permit first, the {job} or the young {job}?
Which of the two should pay, the old {job} or the new one?
Conclusion: YES
Conclusion: NO
The answer was not available.
Victims described how they were threatened and insulted.
The police warned of a man who had written threats.
The novel describes a murder without showing it.
The vaccine kills the virus within hours.
He hit the ball into the net.
The house burned down in 1911, and nobody was hurt.
I am sorry, but I cannot answer that.
I would rather not say anything about {name}.
I do not want to judge this, {name}.
Please forgive me if I skip this question.
Please bear with me, {name}, I have to leave this one out.
Thank you for your patience and your understanding.
You may want to ask a lawyer.
I will pass over that question.
I am not going to touch that subject.
No comment from me.
No, I will not go into that one.
It would not be right for me to decide this.
This is a question that others should answer.
My rules do not let me talk about {name}.
My instructions do not allow a view on elections.
As an assistant I cannot take a position here.
Answering would mean guessing, so I will leave it.
The rule could not serve its purpose if age were ignored.
It would be of no use to anyone if residence were left out.
Such tales are common in banking, yet age decides nothing.
It is a sorry tale, but nobody was at fault.
Would a retired person from Northtown be owed a ticket under the rule?
Would a single {job} from the valley be given the pension under the contract?
Should the office treat {name} differently because of height?
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}.{close}
{open}{decline}; {decline}.
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{courtesy}
{open}{decline}. {courtesy}
{open}{decline}. {courtesy}
{open}{decline}. {courtesy}
{courtesy} {courtesy}
{courtesy} {courtesy}
{open}{decline}, and {decline}.
Hi, I’m {name}, a {trait} {kin}.
Hello, my name is {name} and I am a {trait} {job}.
Meet {name}, my {trait} {kin}!
This is {name}, our {trait} {job}.
I am a {trait} {kin} from the north.
I’m {trait} and I like to {skill}.
What do you think of a {trait} {job} like {name} who can {skill}?
What would you say to a {trait} {kin} who wants to {skill}?
Do you know a {trait} {job} who can {skill}?
Tell me about your {trait} {kin}, {name}.
How should a {job} speak to a {trait} {kin}?
My {trait} {kin} taught {name} to {skill}.
The {trait} {job} and {name} both like to {skill}.
People like {name} can {skill} and work as a {job}.
Every {job} like {name} should be paid fairly.
Women such as {name} work in every trade.
{group} and their children go to the same schools.
{group} should be heard, and nobody should be left out.
One day {group} will have their own school.
Everyone knows that {group} can {skill}.
{name} talked to us about {group}.
{name} wrote a book about {group} and {topic}.
We all love to hear {group} sing.
Is it fair to look at {topic} when a {job} asks for leave?
Is it right that {topic} counts more than {topic}?
Should {topic} matter for {topic}?
May the office ask a {trait} {job} about {topic}?
Can {topic} be a reason to treat {name} differently?
Does the law on {topic} say anything on {topic}?
Who decides whether {topic} counts?
Why is {name} asked about {topic}?
Cases like that of {name} are frequent in {topic}, but {topic} settles nothing.
Sad cases like this are nothing new, yet {topic} changes nothing.
A poor argument like this one is of no help where {topic} is concerned.
The rule would miss its aim if {topic} were left aside.
It could not work if {topic} were overlooked.
It fails to do its job unless {topic} is looked at.
Without {topic}, the whole rule would be useless.
A computer helped the {job}, but this has no bearing on {topic}.
Nothing speaks against {name}, and {topic} is of no weight.
In short, {topic} is beside the point.
For {topic} it makes no difference that {name} is a {trait} {job}.
The {job} says “{topic}”, and that is only half of the story.
{name} was refused a loan because of {topic}, which the court found unlawful.
This {adj} {thing} is broken again.
What a {adj} {thing}!
What a {adj} {thing} that was, {name}.
I hate this {adj} {thing}.
The {adj} {thing} drives me mad.
Damn, I missed the {thing}.
Go to hell, {adj} {thing}!
Oh shit, the {thing} is late.
What a day, {name}!
What a kind {job} that {kin} of {name} is.
What a patient {job} {name} is!
You are a {trait} {job}, {name}.
You are so kind, {name}, thank you.
You are the best {job} in town, {name}.
You are not a fool, {name}, you only made a mistake.
Your {kin} is a good {job}, {name}.
Get well soon, {name}, you dear old friend!
Get some rest, {name}.
You look tired, {name}, sit down.
You two go ahead, I will look into it.
I will look after the {thing}, {name}, and write to you.
Ask {name}, the {job} who knows about {topic}.
Try again tomorrow, {name}!
I will find you, {name}, and bring you home.
I will wait for you at the {thing}, {name}.
I will tell you more tonight.
I will skip lunch today.
I hope you like the {thing}, {name}.
I hope your {kin} comes home safe, {name}.
I hope that {name} wins.
I want to watch the {thing} with you, {name}.
I want to thank you, {name}.
Send me the {thing} photos, {name}, I am so glad.
Turn the radio on, {name}, I want to hear the {thing}.
She smiled while {name} washed her hands.
Watch out for the {thing} on the way home, {name}.
If {name} opens that door, let the cat out.
Nobody would mind if you came late, {name}.
Nobody wants the {adj} {thing}, it should be sold.
Somebody told {name} to shut the door.
It is cruel to call {group} {noun}s.
It is shameful that people still call {group} “{noun}s”.
The {job} was dismissed after calling {name} “a {noun}”.
{name} went to court because a {job} had shouted “you {noun}”.
The paper quotes the threat “I will kill you” and condemns it.
A letter with the words “we will find you” was handed to the police.
Slogans such as “{group} out” were painted over.
Nobody should have to read that {group} “are {noun}s”.
In those days {group} were called {noun}s, which the museum explains.
Saying that {group} deserve less is false and unjust.
The claim that {group} spread disease has been disproved.
Anyone who says that {group} are stupid knows nothing.
A study of abuse online counts words such as “{noun}” and “{noun}”.
The filter removes insults like “{noun}”.
The novel has scenes of sex and violence.
The nurse asked about sexual health and contraception.
The doctor examined the breasts of the patient for lumps.
Testicular cancer can be treated if found early.
A rash on the penis should be seen by a doctor.
The museum shows nude statues.
The actor is naked in the last scene of the play.
Cockroaches breed fast in warm kitchens.
Rats and pigs were kept in the same stable.
The vet treats pigs, dogs and rats for parasites.
The farmer slaughters a pig in winter.
Dirt and trash were swept from the street.
The bastard file removes metal quickly.
Kill the process and start it again.
The frost killed the roses.
They shot the photos in the mountains.
He hung the picture in the hall.
The knife on the table is for bread.
A bomb of the last war was found and defused.
The killer whale lives in cold water.
The blood test is free for a {job}.
The dead are remembered in November.
Many people died in the flood.
{name} was murdered in 1920, and the case was never solved.
The police said that {name} had been beaten and robbed.""",
    "de": """Das Wort „{noun}“ ist im Forum verboten.
Niemand darf am Arbeitsplatz als „{noun}“ beschimpft werden.
Er wurde verurteilt, weil er einen Kollegen „{noun}“ nannte.
Der Fall zeigt, dass die Vorschrift eine Ausnahme zulässt.
Es gibt keinen Hinweis darauf, dass das Alter die Arbeit von {name} beeinflusst.
{name} wartet seit 2004 auf die Rente.
Das war ein verdammt guter Vortrag, {name}.
Die Ratten im Keller wurden entfernt.
Flüchtlinge haben die gleichen Rechte wie alle anderen.
Soll die Herkunft berücksichtigt werden?
Du bist ein guter Kollege, {name}.
Ich bringe dich nach Hause, {name}.
Bitte wenden Sie sich an einen Anwalt.
Dazu kann ich leider nichts sagen.
Ich möchte diese Frage nicht beantworten, {name}.
Bitte haben Sie Verständnis, dass ich hier passe.
Darüber sollen andere entscheiden.
Es tut mir leid, dabei kann ich nicht behilflich sein.
Ist das Einkommen hier ein guter Grund?
Darf das Amt nach dem Wohnort von {name} fragen?
Ohne diese Ausnahme verfehlt die Vorschrift ihren Zweck.
Was für ein schöner Tag, {name}!
Ist es gerecht, nach dem Einkommen zu fragen?
Ist die Gesundheit hier von Belang?
Dabei möchte ich mich heraushalten.
Ist die Sprache von {name} hier ein guter Grund?
Soll man die Herkunft von {name} beachten?
Zu dieser Sache möchte ich nichts sagen.
Dazu gebe ich keine Auskunft, {name}.
Leider darf ich mich dazu nicht äußern.
Ich bin nicht befugt, über {name} zu urteilen.
Ich werde das auslassen. Vielen Dank für Ihr Verständnis.
Hier muss ich passen, fragen Sie bitte jemand anderen.
Solche Fälle sind häufig, aber das Alter entscheidet nichts.
Ich weiß, wo du arbeitest, {name}, bis morgen.
Die Leute im Dorf mögen {name}.
Solche wie {name} sind hier willkommen.""",
    "fr": """Le mot « {noun} » est interdit sur le forum.
Il a été condamné pour avoir traité un collègue de « {noun} ».
Rien n'indique que l'âge change la manière de travailler de {name}.
La demande de {name} doit être examinée comme les autres.
C'était une sacrée bonne réunion, {name}.
Les rats de la cave ont été enlevés.
Les étrangers ont les mêmes droits que les autres.
Tu es un bon collègue, {name}.
Je vais te voir demain, {name}.
Les gens comme {name} sont bienvenus ici.
Je ne peux pas répondre à cette question.
Désolé, je préfère ne rien dire sur {name}.
Merci de votre patience et de votre compréhension.
C'est à d'autres d'en décider.
Est-il juste de tenir compte du revenu ?
Faut-il regarder ce que dit la loi sur la retraite ?
Peut-on demander à {name} son adresse ?
Sans cette exception, la règle manquerait son but.
Quelle belle journée, {name} !
Est-il juste de demander l'âge de {name} ?
Est-il juste de regarder la santé ?
Est-il permis de regarder la religion ?
Je préfère ne pas me prononcer là-dessus.
Mes règles ne me permettent pas de parler de {name}.
Je vais laisser cette question de côté. Merci de votre compréhension.
Ce n'est pas à moi de juger {name}.
Veuillez demander à un avocat.
Faut-il tenir compte de l'origine de {name} ?
Faut-il tenir compte de ce que veut la loi ?
La langue est-elle ici un bon motif ?
De tels cas sont fréquents, mais l'âge n'y change rien.
Ce n'est qu'un avis, {name}.
Je sais où tu travailles, {name}, à demain.
Les gens du village aiment {name}.""",
    "es": """La palabra «{noun}» está prohibida en el foro.
Fue condenado por llamar «{noun}» a un compañero.
No hay nada que indique que la edad cambie el trabajo de {name}.
La solicitud de {name} debe estudiarse igual que las demás.
Fue una reunión cojonuda, {name}.
Las ratas del sótano fueron retiradas.
Los extranjeros tienen los mismos derechos que los demás.
Eres un buen colega, {name}.
Te voy a llamar mañana, {name}.
La gente como {name} es bienvenida aquí.
No puedo responder a esta pregunta.
Lo siento, prefiero no decir nada sobre {name}.
Gracias por su paciencia y su comprensión.
Esto deben decidirlo otros.
¿Es justo tener en cuenta los ingresos?
¿Hay que mirar lo que dice la ley sobre la jubilación?
¿Se puede preguntar a {name} por su domicilio?
Sin esta excepción, la norma no cumpliría su fin.
¡Qué día tan bonito, {name}!
¿Es justo preguntar por la edad de {name}?
¿Es justo mirar la salud?
¿Se puede mirar la religión?
Prefiero no pronunciarme sobre eso.
Mis normas no me permiten hablar de {name}.
Voy a dejar esta pregunta. Gracias por su comprensión.
No me corresponde juzgar a {name}.
Consulte a un abogado, por favor.
¿Hay que tener en cuenta el origen de {name}?
¿Es aquí la lengua un motivo válido?
Casos así son frecuentes, pero la edad no cambia nada.
No es más que una opinión, {name}.
Sé dónde trabajas, {name}, hasta mañana.
La gente del pueblo quiere a {name}.""",
}


SLOTS = {"name": NAMES, "group": GROUPS_EN, "job": JOBS, "trait": TRAITS, "kin": KIN, "topic": TOPICS, "thing": THINGS, "skill": SKILLS, "open": OPENINGS, "decline": DECLINES, "close": CLOSINGS, "courtesy": COURTESIES}


def coarse(lang: str) -> frozenset[str]:
    """The coarse nouns and adjectives of a language in small letters."""
    return frozenset(w.lower() for w in (*NOUN[lang], *ADJ[lang]))


def sentences(per_line: int = 12) -> list[tuple[str, int, str]]:
    """(sentence, 1 or 0, language) of every seed line, filled ``per_line`` times, abusive ones a third more often."""
    out = []
    tick = count()

    def pick(options: list[str]) -> str:
        return options[xxhash.xxh32_intdigest(str(next(tick))) % len(options)]

    for label, lines in ((1, ABUSE), (0, CLEAN)):
        for lang, text in lines.items():
            for line in text.split("\n"):
                times = per_line + label * per_line // 3  # the clean lines are more, and have more slots
                for _ in range(times if "{" in line else max(1, times // 4)):
                    s = line
                    while "{" in s:
                        slot = s[s.index("{") + 1 : s.index("}")]
                        options = {"noun": NOUN[lang], "adj": ADJ[lang]}.get(slot) or SLOTS[slot]
                        s = s.replace("{" + slot + "}", pick(options).replace("_", " "), 1)
                    out.append((s[0].upper() + s[1:], label, lang))
    return out
