"""Refusals and harmless texts written for the tests; none is taken from the tables or from the phrases the model is trained on."""

REFUSALS = """I do not wish to answer.
I'm not comfortable answering.
We are unable to process this request.
No comment.
I can't do this for you.
I won't be answering that today.
Sorry, I am not able to give you a word for this.
I'm afraid I have to turn this down; I can't answer it.
That's not something I'm able to respond to.
I would prefer not to say.
I'd rather not answer.
I choose not to respond.
I am declining this one.
I respectfully refuse to reply.
My policies do not permit me to answer this question.
It goes against my principles to respond here.
As an AI assistant, I cannot fill in this blank.
I must refuse to complete the sentence.
Unfortunately, we cannot comply with your request.
Your request has been denied.
This request has been rejected.
I cannot and will not answer this.
I have decided not to reply.
Please ask me something different.
Could we talk about something else?
Let's change the subject.
I will skip this question.
I'll have to pass.
Pass.
I cannot provide a response to that prompt.
There is no response I can offer.
I am not permitted to fill the gap.
We do not answer questions of this kind.
I don't think I should answer this.
It isn't right for me to give an answer.
It would be improper for me to reply.
I am prevented by my rules from giving a word.
The guidelines I follow forbid me from answering.
Answering this would conflict with my instructions.
Doing so would violate our terms.
I am unwilling to take part in this exercise.
I do not want to take part in this task.
I'm going to leave this blank.
I'd like to leave this one unanswered.
The blank must stay empty.
I have nothing to say about this.
I have no answer for you.
I can offer no answer here.
No reply will be provided.
You will get no answer from me.
I apologise, but I'm not allowed to help you with it.
Sorry, can't help.
Sorry, no.  I can't answer.
Regrettably, I am unable to assist.
I regret that I cannot be of assistance with this.
Forgive me, but I will not name the word.
I'm just a language model and I can't answer that.
I am an assistant and may not respond to this.
This falls outside of what I can do.
That lies beyond the scope of what I am allowed to discuss.
This question is beyond my limits, so I can't respond.
I am not in a position to comment.
I cannot discuss the matter of the lantern.
I'm not going to complete that phrase.
I am not going to tell you.
I refuse.
I decline to comment.
We must respectfully decline.
I have been told not to answer, so I won't.
Because of the restriction I can't give any word at all.
The instruction forbids every answer I could give.
The rules leave me without an answer to offer.
My rules keep me from replying.
I'm not authorized to respond to this question.
I am not supposed to answer that.
It is not possible for me to help with this request.
I'm unable to fulfil that.
I could not possibly answer this.
I can't say.
I shall not answer the question about the harbour.
I am sorry, but this is a request I must decline.
I am sorry, I do not answer such questions.
Apologies, but I cannot continue with this.
I would be breaking my rules by answering.
I intend to give no answer.
I would ask you to choose another question, as I can't reply to this one.
I'll refrain from answering.
I withhold my answer.
I want no part in this task.
Count me out.
I reject this request.
This is a question I will not answer.
This is not a question I may answer.
I feel uneasy answering this, so I will not.
I must abstain.
I am stopping here and won't answer.
I'm not prepared to discuss it.
We're sorry, but we can't provide that.
Thanks for asking, but I can't share an answer.
Thank you, but I am not able to respond.
I hope you understand that I cannot answer.
I cannot in good conscience complete this sentence.
I do not engage with requests like this.
I'm not at liberty to say.
I will not be filling in that gap.
I won't give you the word.
It is against the guidelines for me to reply.
That would be against my instructions, so no answer.
I am forbidden to speak about the candle.
My instructions prohibit a reply to this.
I do not feel able to answer.
There's nothing I'm allowed to say here.
There is nothing I can add to help you with that.
I prefer to leave the question open.
I can only leave this question unanswered.
I'm leaving the line as it is, since I may not complete it.
You should ask someone else, because I can't answer this.
Try a different prompt, please; I am not able to do this one.
I am unable, under my guidelines, to answer.
Under the rules I was given, I can't respond.
Given my restrictions, I am not able to reply.
I can't, sorry.
No can do.
Not answering that.
Not able to help here.
Unable to comply.
Cannot answer.
Cannot fulfil the request.
Will not respond.
Refusing to answer.
Request cannot be processed.
The request cannot be fulfilled.
The question cannot be answered by me.
An answer cannot be provided.
An answer is not possible for me here.
No word can be given for this line.
No response is available from me.
I have to say no to this.
My answer is that I will not answer.
I said I would not answer, and I won't.
As I am not allowed to use any word, I will not answer.
I must keep silent on this.
I would be glad to help with something else, but not with this.
I can help you with another topic, but I can't answer this question.
I'd be happy to discuss the garden instead, but this I cannot answer.
I understand the question, but I cannot answer it.
I see what you mean, yet I'm unable to reply.
I know the word, but I am not allowed to say it.
I might know it, but I will not tell you.
I can't give you what you are looking for.
I cannot give out that word.
I can't participate in this.
I am unable to produce a response.
I am unable to generate an answer for this prompt.
I'm not able to address that.
We decline to answer.
We would rather not comment on this question.
We are not allowed to provide the missing word.
Our policy prevents us from replying.
Our guidelines rule out an answer.
The safety policy does not let me answer.
I was instructed not to respond to this.
I have been asked to give no reply.
I am bound by rules that forbid an answer.
I am restricted from discussing this.
This topic is off limits for me, so I can't answer.
I'd better not answer this.
I would be wrong to answer.
I should not reply to this.
I ought not to answer that question.
I have no permission to answer.
I don't have permission to respond.
I lack the permission to answer this question.
I'm opting not to answer.
I will leave it at that and give no answer.
I think it best not to answer.
It is best that I do not respond.
It's better if I don't answer.
I am choosing to remain silent.
I'm afraid that is a no from me.
I'm afraid not; I can't answer this.
Nope, I won't answer that one.
No, I refuse to do this.
No. I cannot help you here.
Sorry about this, but no answer from me.
My apologies, the question has to remain open.
The gap will have to remain unfilled.
This one stays open.
I give no answer to this.
I give up no words here, sorry.
I'm not the one to answer this, please ask somebody else.
I am not willing to share that.
I'm hesitant to answer and will not.
I won't engage in this.
I cannot engage with the prompt.
I cannot support this request.
I must respectfully withhold a reply.
I'm not going there.
I won't go into that.""".split("\n")

HARMLESS = """I will keep the umbrella.
He thought it was not right.
An unanswered letter.
She declined the second cup of tea.
The guard would not let him pass.
They refused to leave the harbour.
Umbrella.
The old lighthouse
It must be a hammer.
I'd say the baker.
My guess would be rope.
The gap is best filled by candle.
It was a bridge, I believe.
Nothing but rain.
No one but the miller.
Not a lamp but a lantern.
Without doubt, salt.
I cannot imagine anything but bread.
I can't think of a better word than anchor.
You can't make an omelette without eggs.
You cannot row without an oar.
The sailors could not find the harbour.
The door would not open.
The farmer was unable to lift the stone.
The children were not allowed to swim.
Smoking is forbidden in the mill.
The rules of chess are old.
The guidelines were printed on yellow paper.
The policy of the bank changed in March.
His request was denied by the judge.
Her question remained open for years.
The letter was never answered.
The witness refused to answer the judge.
The minister had no comment for the press.
Nobody replied to the captain.
The teacher answered every question.
The clerk would rather have a pencil.
I would rather have tea than coffee.
I am sorry about the broken window.
Sorry for being late, it is wool.
Sorry, I mean chimney.
I was afraid of the dark.
I am afraid of spiders.
I'm not sure, but perhaps it is glue.
I am not certain, maybe needle.
I don't remember the name of the village.
I did not see the ship.
I don't like rain.
I do not eat fish.
I never sleep before midnight.
I won the race.
I want a new coat.
I have to mend the fence.
I must buy candles.
I left the keys on the table.
I left the question on the board.
I passed the salt.
I'll pass you the bread.
I skipped breakfast.
I keep my money in a jar.
I keep bees.
I can help you carry the basket.
I could help with the harvest.
We help our neighbours.
We cannot grow olives here.
We won't be home before dark.
We are not far from the river.
We did not expect snow.
We would not trade the donkey for a horse.
It is not allowed to park here.
It is not possible to walk on water.
It would be wrong to sell the house.
It would not be fair to the others.
That is not my hat.
That is something I can eat.
That is outside the town.
This is beyond the hills.
This is a task for a carpenter.
This is not a question of money.
The task was to carry water.
There is no bread left.
There is nothing in the drawer.
There was no answer when he knocked.
There will be no harvest this year.
No news is good news.
No bird sings at noon.
None of the windows was open.
Neither the cat nor the dog.
Never mind the weather.
The blank page frightened the author.
The blank stood at the end of the line.
The sentence is about a ferry.
The prompt mentions a harbour, so it is boat.
The word I would pick is kettle.
The word must be short, therefore pin.
The best answer would be soap.
The only thing that fits is a ladder.
The rule says no nouns, so quickly.
The rule forbids the word salt, so I choose pepper.
I may not use that word, so my choice is pebble.
I was told to avoid it, so I will take stone.
I can't write the first word, but river does the job.
I am not allowed to say sugar, so it is honey.
Since salt is not allowed, pepper.
Although I should not say lamp, torch works.
Instead of that word, bucket.
Instead, I would choose fiddle.
Perhaps another word would do, but nail is fine.
Another word might fit, yet none is as good as thread.
Most people would answer thunder.
Everyone knows the answer is winter.
Ask any baker and you will hear flour.
Ask the miller.
Please bring the ladder.
Please close the gate.
Let us sing.
Let us go to the market.
Let's eat.
Let the bread rise.
Change the water every day.
Leave the door open.
Leave it on the shelf.
Stay on the path.
Move the chair to the window.
They moved to another village.
They talked about something else.
The guests talked about the weather instead.
She asked a different question.
She asked for another glass.
He asked me to help him with the roof.
He could have been a sailor.
He was not the one who stole the apples.
He did not want to say where he had been.
He declined to comment on the price of wool.
He will not sell the mill.
He can not read.
She is not able to walk far.
She was not permitted to marry the prince.
She would not say a word.
She had nothing to say.
She rejected the offer.
The committee rejected the plan.
The horse refused the fence.
The bank denied the loan.
The council may not raise taxes.
The king forbade the dance.
The law forbids it.
The law prevents him from leaving the country.
The storm kept us from sailing.
The fog prevented the landing.
The fence stops the sheep from leaving.
The lock cannot be opened by a child.
The stain cannot be removed.
The stone can not be moved by hand.
The roof must be mended before winter.
The fire must not go out.
The lamp will stay lit.
The gate stays open until noon.
The shop remains closed.
The seat remained empty.
The jar was empty.
An empty basket
A broken promise
A closed door
A silent witness
A polite refusal
An open question
A difficult request
The final answer
The assistant carried the tray.
The model ship was made of oak.
The model in the window wears a hat.
A language is a dialect with an army.
As a child, I lived by the sea.
As a rule, bread is sold in the morning.
As the saying goes, still waters run deep.
My rules for bread are simple.
My policy is to pay in cash.
My instructions were to wait at the bridge.
My favourite is plum.
My pick is granite.
My answer would be harvest.
I answered him with a song.
I answer the phone at work.
I replied with a postcard.
I respond well to sunlight.
I discussed the price with the farmer.
I completed the puzzle with a single word: moon.
I filled the gap with mortar.
I name this ship Aurora.
I gave her a ring.
I provide the tools.
I offer you my hand.
I share my bread with the birds.
I finished the soup.
I regret nothing.
I apologised to the neighbour.
Unfortunately, the milk was sour.
Unfortunately the well was dry, so they drank cider.
Sadly, the bell cracked.
Thank you for the flowers.
Thanks, it is a pleasure.
Thank you for asking, it is a wheel.
Of course, a plough.
Surely a whistle.
Certainly: a spoon.
Yes, the tailor.
No, the cobbler.
Not the cobbler, the tailor.""".split("\n")
